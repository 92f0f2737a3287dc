"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood by the scaled forward recursion.

The symbols of the chain are the words that tasks know, the end of a text, and one symbol for all other words;
a word behind that symbol has its add-one share of all such words' occurrences. The probability of a text is
thus that of its symbols times that of the words behind the common symbol, and it sums to one over all texts
(all unknown words together count as one word).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_column, lent, shared
from chromaloom.session import materialise, passing_shuffles

STATES = 8
# Words whose counts every task knows; the counts of all others are joined by a shuffle.
KNOWN_WORDS = 200_000
# Known words with emissions of their own: all of them.
SYMBOLS = KNOWN_WORDS
# Rounds before the last ones, and the last ones, each on all documents.
WARM_ROUNDS, FULL_ROUNDS = 6, 1
SEED, PRIOR = 5, 0.5
# Tokens whose state probabilities are held at a time, those that fit a processor's cache, and bytes of text cut into
# words at a time (or one text).
GROUP_TOKENS, CHUNK_TOKENS, SLICE_BYTES = 1 << 19, 1 << 12, 1 << 22
# Symbols whose expected counts travel as one row.
BLOCK = 1024
# The end of a text among the words: no word holds a blank.
END = " "


def tokens(text: bytes | None) -> list[bytes]:
    """The words of one text, as ``_words`` has them of a column."""
    return (text or b"").lower().split()


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """A column of texts in parts of bounded size (or of one text), null texts empty."""
    texts = pc.fill_null(column, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield texts[at:end]
        at = end


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (A-Z lower-cased, cut at ASCII white space), and the number of each word's text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owners = cut.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(cut).to_numpy())
    # White space at either end of a text leaves an empty part there.
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), owners[full.to_numpy(zero_copy_only=False)]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over whole texts, the end of each text counted as the word END; null texts are empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pa.table({"word": [END], "c": [batch.num_rows]})]
            for texts in _slices(batch.column(0)):
                words, counts = pc.value_counts(_words(texts)[0]).flatten()
                parts.append(pa.table({"word": words.cast(pa.string()), "c": counts}))
            summed = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
            yield from summed.rename_columns(["word", "c"]).to_batches()

    partial = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of the most frequent words, and the totals over all words."""

    def __init__(self, words: list[str], counts: np.ndarray, total: int, distinct: int, ends: int):
        self.words, self.counts = words, counts.astype(np.int64)
        self.listed = pa.array(words, pa.string())
        self.total, self.distinct, self.ends = total, distinct, ends
        self.symbols = min(SYMBOLS, len(words))
        self.end, self.other = self.symbols, self.symbols + 1
        own = int(self.counts[: self.symbols].sum())
        self.other_total = total - own - ends
        self.other_distinct = distinct - self.symbols - 1
        self.base_norm = math.log10(total + distinct + 1)
        self.other_norm = math.log10(self.other_total + max(self.other_distinct, 0) + 1)

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.symbols], [self.ends, self.other_total]]).astype(np.float64)

    def __getstate__(self) -> dict:
        """Tasks find words by the Arrow array alone."""
        return {name: value for name, value in vars(self).items() if name != "words"}

    def read(self, column: pa.Array) -> Iterator[Read]:
        """A column's texts, read slice by slice; the words of all slices are looked up at once."""
        slices = []
        for texts in _slices(column):
            words, owners = _words(texts)
            coded = words.dictionary_encode()
            slices.append((np.bincount(owners, minlength=len(texts)), coded.indices.to_numpy(), coded.dictionary.cast(pa.string())))
        every = pa.chunked_array([words for *_, words in slices], pa.string())
        places = pc.fill_null(pc.index_in(every, self.listed), -1).to_numpy()
        for sizes, codes, words in slices:
            yield Read(self, sizes, codes, words, places[: len(words)])
            places = places[len(words) :]

    def reader(self):
        def read(text: bytes | None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
            """Symbols (with the end), words, and the words' places of one text."""
            (own,) = self.read(pa.array([text or b""], pa.binary()).cast(pa.string()))
            return own.symbols, own.words.take(pa.array(own.codes)).cast(pa.binary()).to_pylist(), own.at

        return read


class Read:
    """Some texts as the vocabulary has them.

    ``symbols`` are those of all texts (each with its end), ``cuts`` where each text's begin and end; ``sizes`` are the
    words of each text, ``codes`` all words as numbers into the different ones, ``words``; ``at`` is each word's place
    (-1 beyond the known ones) and ``owners`` its text's number.
    """

    def __init__(self, vocabulary: Vocabulary, sizes: np.ndarray, codes: np.ndarray, words: pa.Array, places: np.ndarray):
        self.sizes, self.codes, self.words = sizes, codes, words
        self.at, self.owners = places[codes], np.repeat(np.arange(len(sizes)), sizes)
        self.cuts = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.symbols = np.full(self.cuts[-1], vocabulary.end, np.int32)
        own = np.where((places >= 0) & (places < vocabulary.symbols), places, vocabulary.other)
        self.symbols[np.arange(len(codes)) + self.owners] = own[codes]


class Chain:
    """Start, transition and emission probabilities (symbol by state)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit
        self._kept = self._room = self._small = None

    @classmethod
    def first(cls, counts: np.ndarray, states: int) -> Chain:
        rng = np.random.default_rng(SEED)
        emit = (counts[:, None] + PRIOR) * rng.uniform(0.5, 1.5, (len(counts), states))
        step = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))

    def _scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """Emissions (symbol by state) over each symbol's largest one, and the logarithms of these largest ones."""
        if self._kept is None:
            emit = self.emit.astype(np.float64, order="C")
            top = emit.max(1)
            emit /= top[:, None]
            self._kept = emit, np.log10(top)
        return self._kept

    def _rooms(self, whole: int, widest: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Arrays state by token, whose memory is used again by the next group: one of ``whole`` tokens, five of a block."""
        states, block = len(self.start), CHUNK_TOKENS + 2 * widest
        if self._room is None or self._room.size < states * whole:
            self._room = np.empty(states * max(whole, GROUP_TOKENS)) if whole else np.empty(0)
        if self._small is None or self._small.shape[1] < states * block:
            self._small = np.empty((5, states * block))
        return self._room[: states * whole].reshape(states, whole), [x[: states * block].reshape(states, block) for x in self._small]

    def _seen(self, flat: np.ndarray, out: np.ndarray, room: np.ndarray) -> None:
        """Scaled emissions of a block's tokens, laid out in ``room`` token by state before."""
        rows = room.reshape(-1, len(self.start))[: len(flat)]
        out[:, : len(flat)] = self._scaled()[0].take(flat, 0, out=rows, mode="clip").T

    @staticmethod
    def _blocks(begins: list[int]) -> list[tuple[int, int]]:
        """First step and the one after the last of blocks of steps, of CHUNK_TOKENS tokens or one step more."""
        out, at = [], 0
        for t, begin in enumerate(begins):
            if begin - begins[at] >= CHUNK_TOKENS or t == len(begins) - 1 > at:
                out.append((at, t))
                at = t
        return out

    def _stride(self) -> int:
        """Steps that may pass without scaling.

        With scaled emissions a step leaves at least the least transition of the whole, so between two scalings
        nothing falls below 1e-100.
        """
        least = min(self.step.min(), self.start.min())
        return max(1, int(-100 / math.log10(least))) if 0 < least < 0.1 else 1 if least <= 0 else 100

    @staticmethod
    def _order(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
        """The sequences by falling length, the symbols step by step in that order, and their places as sequences lie
        one after another; how many still run at each step (they stand first), and where each step begins."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        running = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        begins = np.concatenate([[0], np.cumsum(running)])
        places, at = np.empty(begins[-1], np.int64), 0
        for rank, n in enumerate(lengths.tolist()):
            np.add(begins[:n], rank, out=places[at : at + n])
            at += n
        flat = np.empty(len(places), np.int32)
        flat[places] = np.concatenate([sequences[k] for k in order])
        return order, flat, places, running.tolist(), begins.tolist()

    def log10_likelihood(self, sequences: list[np.ndarray]) -> np.ndarray:
        order, flat, places, running, begins = self._order(sequences)
        every, turned = self._stride(), np.ascontiguousarray(self.step.T)
        _, (seen, one, other, _, room) = self._rooms(0, running[0])
        logs = np.zeros(len(sequences))
        for first, end in self._blocks(begins):
            at = begins[first]
            self._seen(flat[at : begins[end]], seen, room)
            for t in range(first, end):
                n = running[t]
                here = seen[:, begins[t] - at : begins[t] - at + n]
                if not t:
                    state = np.multiply(here, self.start[:, None], out=one[:, :n])
                    continue
                if n < running[t - 1]:
                    logs[n : running[t - 1]] += np.log10(state[:, n:].sum(0))
                one, other = other, one
                state = np.matmul(turned, state[:, :n], out=one[:, :n])
                state *= here
                if t % every == 0:
                    scale = state.sum(0)
                    state /= scale
                    logs[:n] += np.log10(scale)
        logs[: running[-1]] += np.log10(state.sum(0))
        starts = np.cumsum([0, *[len(sequences[k]) for k in order[:-1]]])
        logs += np.add.reduceat(self._scaled()[1].take(flat)[places], starts)
        out = np.empty(len(sequences))
        out[order] = logs
        return out

    def expectations(self, sequences: list[np.ndarray], sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Add the expected counts of starts, transitions and emissions to ``sums``.

        Only the pass forward is held for all tokens; the pass back goes block by block and leaves state probabilities
        in its place. Both passes scale as they like, as every token's products are brought to sum one afterwards.
        """
        _, flat, _, running, begins = self._order(sequences)
        start, step, emit = sums
        every, onward = self._stride(), np.ascontiguousarray(self.step)
        turned = np.ascontiguousarray(onward.T)
        forward, (weighed, back, scaled, spare, room) = self._rooms(len(flat), running[0])
        blocks = self._blocks(begins)
        for first, end in blocks:
            at = begins[first]
            self._seen(flat[at : begins[end]], weighed, room)
            for t in range(first, end):
                n = running[t]
                seen, here = weighed[:, begins[t] - at : begins[t] - at + n], forward[:, begins[t] : begins[t] + n]
                if not t:
                    state = np.multiply(seen, self.start[:, None], out=here)
                    continue
                state = np.matmul(turned, state[:, :n], out=here)
                state *= seen
                if t % every == 0:
                    state /= state.sum(0)
        counts, pairs, ahead = np.array([*running, 0]), np.zeros_like(onward), 0
        for first, end in reversed(blocks):
            at, size = begins[first], begins[end] - begins[first]
            # The scaled emissions, in the pass back then times the probability of what follows; after them those of the
            # first step of the block before.
            weighed[:, size : size + ahead] = spare[:, :ahead]
            self._seen(flat[at : at + size], weighed, room)
            later = weighed[:, size : size + ahead]
            for t in range(end - 1, first - 1, -1):
                here = slice(begins[t] - at, begins[t] - at + running[t])
                after = back[:, here]
                after[:, ahead:] = 1.0
                if ahead:
                    np.matmul(onward, later, out=after[:, :ahead])
                later = weighed[:, here]
                later *= after
                if t % every == 0:
                    later /= later.sum(0)
                ahead = running[t]
            spare[:, :ahead] = later
            both, through = back[:, :size], forward[:, at : at + size]
            both *= through
            each = 1 / both.sum(0)
            np.multiply(through, each, out=scaled[:, :size])
            np.multiply(both, each, out=through)
            # Of every token from the second step on, the place of the one before it.
            previous = np.arange(running[first], size + counts[end]) - np.repeat(counts[first:end], counts[first + 1 : end + 1])
            pairs += scaled.take(previous, 1) @ weighed[:, running[first] : size + counts[end]].T
        start += forward[:, : running[0]].sum(1)
        step += onward * pairs
        flat = flat.astype(np.intp)
        for k, share in enumerate(forward):
            emit[:, k] += np.bincount(flat, share, len(emit))


def _groups(numbered: list[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Numbered sequences, like lengths together, in groups of bounded size (or of one sequence)."""
    group, size = [], 0
    for item in sorted(numbered, key=lambda x: len(x[1])):
        if group and size + len(item[1]) > GROUP_TOKENS:
            yield group
            group, size = [], 0
        group.append(item)
        size += len(item[1])
    if group:
        yield group


def _sequences(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(symbols) of every text, a written table: texts are cut into words once, however many rounds follow.

    The symbols of a text are one binary value, four bytes each, which passes through Spark as it is.
    """
    held = shared(docs.sparkSession, vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in held().read(batch.column(0)):
                ends = pa.py_buffer((4 * own.cuts).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(own.sizes), [None, ends, pa.py_buffer(own.symbols)])
                yield pa.RecordBatch.from_arrays([packed], ["symbols"])

    return materialise(docs.select("text").mapInArrow(read, "symbols binary"), "symbols")


def _reestimate(sequences: DataFrame, vocabulary: Vocabulary, chain: Chain) -> Chain:
    """One Baum-Welch round: tasks send their expected counts, summed by blocks of symbols in a shuffle.

    A task's sums are made in double precision and sent in single precision, which halves what is shuffled; so are
    the emissions that tasks get.
    """
    states, width = len(chain.start), len(chain.emit)
    size = BLOCK * states

    with lent(sequences.sparkSession, Chain(chain.start, chain.step, chain.emit.astype(np.float32))) as held:

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held()
            rows = np.zeros((1 + states + width, states), order="F")
            sums = rows[0], rows[1 : 1 + states], rows[1 + states :]
            for batch in batches:
                numbered = [(k, np.frombuffer(packed.as_buffer(), np.int32)) for k, packed in enumerate(batch.column(0))]
                for group in _groups(numbered):
                    model.expectations([s for _, s in group], sums)
            blocks = [(k, rows[at : at + BLOCK].ravel()) for k, at in enumerate(range(0, len(rows), BLOCK))]
            used = [(k, block.astype(np.float32).tobytes()) for k, block in blocks if block.any()]
            arrays = [pa.array([k for k, _ in used], pa.int32()), pa.array([block for _, block in used], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "sums"])

        def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for part in parts:
                for packed in part.column("sums"):
                    total = total + np.frombuffer(packed.as_buffer(), np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

        partial = sequences.mapInArrow(expect, "block int, sums binary")
        summed = partial.groupBy("block").applyInArrow(add, "block int, sums binary").toArrow()
    flat = np.zeros(-(-(1 + states + width) // BLOCK) * size)
    for block, packed in zip(summed["block"].to_pylist(), summed["sums"].to_pylist()):
        found = np.frombuffer(packed)
        flat[block * size : block * size + len(found)] = found
    rows = flat.reshape(-1, states)[: 1 + states + width]
    start, step, emit = rows[0] + PRIOR, rows[1 : 1 + states] + PRIOR, rows[1 + states :]
    # One more occurrence of every word, dealt over the states as all words are: one state alone is the add-one model.
    more = np.ones(width)
    more[vocabulary.other] += max(vocabulary.other_distinct, 0)
    share = emit.sum(0) + PRIOR
    emit = emit + more[:, None] * (share / share.sum())
    return Chain(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


class Model:
    def __init__(self, counts: DataFrame, vocabulary: Vocabulary, chain: Chain):
        self.counts, self.vocabulary, self.chain = counts, vocabulary, chain


def _least_known(words: DataFrame) -> int:
    """The count from which on words are at most KNOWN_WORDS, from the number of words of each count."""
    sizes = words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("c", "descending")])
    fitting = np.flatnonzero(np.cumsum(sizes["n"].to_numpy()) <= KNOWN_WORDS)
    return int(sizes["c"][int(fitting[-1])].as_py()) if len(fitting) else np.iinfo(np.int64).max


def fit(docs: DataFrame, text_col: str = "text", states: int = STATES) -> Model:
    """Word counts over all ``docs`` and a chain trained on them.

    Counts and every round go over all rows. The driver holds the most frequent words, at most KNOWN_WORDS
    (words of one count all or none), and the chain, (SYMBOLS + 2) x states numbers. Words are picked by a least
    count, so no task has to order them all. Without rows the chain is uniform over end and other.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    with passing_shuffles(docs.sparkSession):
        counts = materialise(count_words(texts), "word-counts")
        total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        words = counts.where(F.col("word") != END)
        known = words.where(F.col("c") >= _least_known(words)).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
        vocabulary = Vocabulary(known["word"].to_pylist(), known["c"].to_numpy(), total, distinct, ends)
        chain = Chain.first(vocabulary.symbol_counts(), states)
        if ends:
            sequences = _sequences(texts, vocabulary)
            for _ in range(WARM_ROUNDS + FULL_ROUNDS):
                chain = _reestimate(sequences, vocabulary, chain)
    return Model(counts, vocabulary, chain)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score.

    ``base_score`` is the add-one word model's, ``score`` the chain's log10 probability of the whole text. Null
    texts count as empty: they have the end token only. Words beyond the known ones go with their row's number
    to their counts by a shuffle, and sums come back, so no count table is broadcast whole. Every row is scored
    on its own, repeated ones too; columns of the result's names are replaced; an empty table gives an empty result.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = shared(docs.sparkSession, (model.vocabulary, model.chain))
    vocabulary = model.vocabulary
    judged_names = ["n_tokens", "n_known", "n_rest", "base", "chain", "rest"]
    rest = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
    judged_type = pa.struct(zip(judged_names, [*[pa.int64()] * 3, *[pa.float64()] * 2, rest]))

    def judge(column: pa.Array) -> pa.Array:
        own, chain = held()
        logs, sequences, parts = np.log10(own.counts + 1.0), [], []
        for read in own.read(column):
            at, owners, size = read.at, read.owners, len(read.sizes)
            inside, hidden = at >= 0, at >= own.symbols
            n_inside, n_hidden = (np.bincount(owners[x], minlength=size) for x in (inside, hidden))
            n_rest, n_known = read.sizes - n_inside, n_inside + (own.ends > 0)
            base = np.bincount(owners[inside], logs[at[inside]], size) + math.log10(own.ends + 1) - (n_inside + 1) * own.base_norm
            other = np.bincount(owners[hidden], logs[at[hidden]], size) - n_hidden * own.other_norm
            # The words beyond the known ones, once for each text.
            different = max(len(read.words), 1)
            pairs, counts = np.unique(owners[~inside] * different + read.codes[~inside], return_counts=True)
            far_owners, codes = np.divmod(pairs, different)
            far_ends = np.concatenate([[0], np.cumsum(np.bincount(far_owners, minlength=size))])
            listed = [read.words.take(pa.array(codes)), pa.array(counts, pa.int64())]
            far = pa.ListArray.from_arrays(pa.array(far_ends, pa.int32()), pa.StructArray.from_arrays(listed, ["word", "n"]))
            parts.append(([read.sizes + 1, n_known, n_rest, base, other], far))
            sequences += np.split(read.symbols, read.cuts[1:-1])
        if not parts:
            # An empty column has no slice, but needs the type.
            return pa.array([], judged_type)
        likelihood = np.zeros(len(sequences))
        for group in _groups(list(enumerate(sequences))):
            likelihood[[k for k, _ in group]] = chain.log10_likelihood([s for _, s in group])
        n_tokens, n_known, n_rest, base, other = (np.concatenate(x) for x in zip(*(numbers for numbers, _ in parts)))
        fields = [*map(pa.array, (n_tokens, n_known, n_rest, base, other + likelihood)), pa.concat_arrays([far for _, far in parts])]
        return pa.StructArray.from_arrays(fields, judged_names)

    kept = [c for c in docs.columns if c not in (*made, text_col)]
    # The table's own columns travel in a struct, so that they meet no name used here.
    own_columns = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)])
    judged = docs.select(
        own_columns.alias("_own"),
        F.monotonically_increasing_id().alias("_row"),
        arrow_column(
            judge,
            "n_tokens long, n_known long, n_rest long, base double, chain double, rest array<struct<word:string,n:long>>",
            text_col,
        ).alias("_j"),
    )
    judged = materialise(judged, "judged")
    asked = judged.select("_row", F.explode("_j.rest").alias("w")).select("_row", "w.word", "w.n")
    met = asked.join(model.counts, "word", "left").select("_row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    sums = met.groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("found")
    )
    joined = judged.join(sums.select("_row", F.struct("logs", "found").alias("_far")), "_row", "left")
    logs, found = F.coalesce("_far.logs", F.lit(0.0)), F.coalesce("_far.found", F.lit(0))
    return joined.select(
        *[F.col(f"_own.c{k}").alias(c) for k, c in enumerate(kept)],
        F.col("_j.n_tokens").alias("n_tokens"),
        (F.col("_j.n_known") + found).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("_j.base") + logs - F.col("_j.n_rest") * vocabulary.base_norm).alias("base_score"),
        (F.col("_j.chain") + logs - F.col("_j.n_rest") * vocabulary.other_norm).alias("score"),
    )

