"""Benchmark decontamination by latent semantic retrieval.

Passages of the benchmark are TF-IDF vectors, with document frequencies counted over the whole corpus. A
distributed randomised SVD gives their latent space; windows of the documents are folded into it and
compared by cosine. Candidates are checked by the longest common subsequence with the item around the place
found, and near misses also by the item's answer, so paraphrases count and chance likeness does not.

Words are runs of letters, digits and non-ASCII characters in lower case, known by a 64-bit hash. In scripts
written without blanks, words are the pairs of neighbouring characters.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_column, shared

# Hashed features, latent directions, and extra directions of the random projection.
FEATURES, RANK, EXTRA, SEED = 1 << 17, 128, 8, 3
# Words of a passage; items are cut densely, documents at every half passage.
PASSAGE, ITEM_STEP, DOC_STEP = 16, 4, 8
COSINE = 0.5
# Bounds are held a little below the cosine, beyond what rounding may take off.
LOOSE = 0.999 * COSINE
# So few passages are met word by word, more through the latent vectors of the windows.
FEW = 32
# Shares of an item's words found in order: enough alone, or enough together with this share of the answer's.
LCS_SURE, LCS_LIKELY, ANSWER = 0.7, 0.45, 0.8
# Shorter items cannot be told from ordinary text and are not searched.
LEAST_WORDS = 5
# Items broadcast at a time; a larger benchmark is searched in blocks.
BLOCK_ITEMS = 20_000
CHUNK = 1 << 18
# Windows whose latent vectors are made at a time, those that fit a processor's cache.
WINDOWS = 128
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BY_ROW, _BY_ITEM = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
# Thai, Lao, Tibetan, Myanmar, Khmer, Tai scripts, Han, kana and bopomofo.
_UNSPACED = re.compile(
    "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u302f"
    "\u3031-\u303c\u3040-\u30fa\u30fc-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+"
)
# The first character of these scripts and of the punctuation below.
_FIRST = 0x0E00
# General, ideographic and full-width punctuation.
_MARKS = re.compile("[\u2010-\u2027\u2030-\u205e\u3000-\u3004\u3008-\u3020\u3030\u30fb\ufe30-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")


def _pairs(run: re.Match) -> str:
    text = run.group()
    return f" {' '.join(map(operator.add, text, text[1:])) or text} "


def _spaced(text: str) -> str:
    """Runs of an unspaced script as their pairs of neighbouring characters."""
    if text.isascii() or np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).max() < _FIRST:
        return text
    return _UNSPACED.sub(_pairs, _MARKS.sub(" ", text))


class Words:
    """Hashes of the words of texts, by differences of one running polynomial sum."""

    def __init__(self) -> None:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        up, down = np.full(2 * CHUNK, _ODD, np.uint64), np.full(2 * CHUNK, inverse, np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.inner = np.zeros(256, bool)
        for first, last in ((48, 57), (97, 122), (128, 255)):
            self.inner[first : last + 1] = True

    def _hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = self.inner[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * self.down[starts]
        value ^= value >> np.uint64(31)
        return starts, value * _ODD

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The hashes of each text in turn; texts are hashed together, up to a chunk at a time."""
        waiting: list[bytes] = []
        held = 0
        for text in texts:
            data = b" " + _spaced((text or "").lower()).encode("utf-8", "replace") + b" "
            if held + len(data) > CHUNK and waiting:
                yield from self._together(waiting)
                waiting, held = [], 0
            if len(data) > CHUNK:
                yield self._long(data)
                continue
            waiting.append(data)
            held += len(data)
        if waiting:
            yield from self._together(waiting)

    def _together(self, parts: list[bytes]) -> Iterator[np.ndarray]:
        starts, value = self._hashes(np.frombuffer(b"".join(parts), np.uint8))
        ends = np.cumsum([len(p) for p in parts])
        yield from np.split(value, np.searchsorted(starts, ends[:-1]))

    def _long(self, data: bytes) -> np.ndarray:
        out, start = [], 0
        while start < len(data):
            cut = min(start + CHUNK, len(data))
            if cut < len(data):
                back = data.rfind(b" ", start + 1, cut)
                cut = back if back > start else cut
            out.append(self._hashes(np.frombuffer(b" " + data[start:cut] + b" ", np.uint8))[1])
            start = cut
        return np.concatenate(out)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Rows, and rows that hold a word of each feature, over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, rows = Words(), np.zeros(FEATURES + 1, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for hashed in words.of(batch.column(0).to_pylist()):
                seen[np.unique((hashed & np.uint64(FEATURES - 1)).astype(np.int64))] += 1
        seen[FEATURES] = rows
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["feature", "n"])

    partial = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "feature long, n long")
    summed = partial.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FEATURES + 1, np.int64)
    out[summed["feature"].to_numpy()] = summed["n"].to_numpy()
    return int(out[FEATURES]), out[:FEATURES]


def _cut(length: int, step: int, width: int = PASSAGE) -> np.ndarray:
    """Starts of the passages of a text; the last one ends with the text."""
    last = max(length - width, 0)
    starts = np.arange(0, last + 1, step)
    return starts if starts[-1] == last else np.append(starts, last)


def _vectors(hashed: np.ndarray, idf: np.ndarray, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, features, weights of length 1) of each passage."""
    feature = (hashed & np.uint64(FEATURES - 1)).astype(np.int64)
    for start in _cut(len(feature), step):
        used, times = np.unique(feature[start : start + PASSAGE], return_counts=True)
        weight = times * idf[used]
        yield int(start), used, weight / np.sqrt((weight**2).sum())


def _gaussian(features: np.ndarray, width: int) -> np.ndarray:
    """Rows of a fixed Gaussian matrix, each from its own number, so that only the rows in use exist."""
    return np.array([np.random.default_rng([SEED, int(f)]).standard_normal(width) for f in features]).reshape(-1, width)


class Rows:
    """A matrix with few rows other than zero: their features in order, and their values."""

    def __init__(self, features: np.ndarray, values: np.ndarray):
        self.features, self.values = features, values

    def at(self, features: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.zeros((len(features), self.values.shape[1]))
        place = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        return np.where((self.features[place] == features)[:, None], self.values[place], 0.0)


def _products(items: DataFrame, idf: np.ndarray, basis: Rows | None, gram: bool) -> Rows:
    """Over all passages A: A^T A basis, or (A basis)^T (A basis), summed over tasks; no basis is a Gaussian one.

    Tasks and driver hold the rows that some passage uses, no others.
    """
    width = RANK + EXTRA
    held = shared(items.sparkSession, (idf.astype(np.float32), basis))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (weights, given) = Words(), held()
        for batch in batches:
            passages = [
                (used, weight)
                for hashed in words.of(batch.column(0).to_pylist())
                if len(hashed) >= LEAST_WORDS
                for _, used, weight in _vectors(hashed, weights, ITEM_STEP)
            ]
            if not passages:
                continue
            features = np.unique(np.concatenate([used for used, _ in passages]))
            at = _gaussian(features, width) if given is None else given.at(features)
            out = np.zeros((width if gram else len(features), width))
            for used, weight in passages:
                rows = np.searchsorted(features, used)
                latent = weight @ at[rows]
                if gram:
                    out += np.outer(latent, latent)
                else:
                    out[rows] += np.outer(weight, latent)
            keys = np.arange(width) if gram else features
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(out[:, j]) for j in range(width)]], names)

    names = ["row", *[f"c{j}" for j in range(width)]]
    partial = items.select("text").mapInArrow(multiply, "row long, " + ", ".join(f"{n} double" for n in names[1:]))
    summed = partial.groupBy("row").agg(*[F.sum(n).alias(n) for n in names[1:]]).toArrow().sort_by("row")
    values = np.empty((summed.num_rows, width))
    for j, name in enumerate(names[1:]):
        values[:, j] = summed[name].to_numpy()
    return Rows(summed["row"].to_numpy(), values)


def latent_basis(items: DataFrame, idf: np.ndarray) -> Rows:
    """RANK columns: the leading right singular vectors of all benchmark passages.

    Random projection, one power step and Rayleigh-Ritz: three jobs that sum small products over tasks. The
    driver holds FEATURES x (RANK + EXTRA) numbers at most, however large the benchmark is.
    """
    basis = None
    for _ in range(2):
        product = _products(items, idf, basis, gram=False)
        q = np.linalg.qr(product.values)[0]
        basis = Rows(product.features, np.zeros_like(product.values))
        basis.values[:, : q.shape[1]] = q
    gram = _products(items, idf, basis, gram=True).values
    if not len(gram):
        return Rows(basis.features, np.zeros((0, RANK)))
    _, turned = np.linalg.eigh(gram)
    return Rows(basis.features, basis.values @ turned[:, ::-1][:, :RANK])


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    places: dict[int, int] = {}
    for k, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        hit = row & places.get(word, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Index:
    """A block of benchmark items: their words, answers and latent passages, and what documents need to meet them."""

    def __init__(self, rows: list[tuple[int, str, str | None]], idf: np.ndarray, basis: Rows):
        self.idf = idf
        words = Words()
        self.ids, self.words, self.answers = [], [], []
        known = np.zeros(FEATURES, bool)
        latent, owner, offset = [], [], []
        texts = list(words.of([text for _, text, _ in rows]))
        answers = list(words.of([answer if answer is not None else last_sentence(text) for _, text, answer in rows]))
        for (item, _, _), hashed, answer in zip(rows, texts, answers):
            if len(hashed) < LEAST_WORDS:
                continue
            known[(hashed & np.uint64(FEATURES - 1)).astype(np.int64)] = True
            for start, used, weight in _vectors(hashed, idf, ITEM_STEP):
                z = weight @ basis.at(used)
                size = (z**2).sum()
                if size > 0:
                    # A passage's own product with this is 1, whatever part of it the latent space keeps.
                    latent.append(z / size)
                    owner.append(len(self.ids))
                    offset.append(start)
            self.ids.append(item)
            self.words.append(hashed)
            self.answers.append(answer)
        self.sets = [frozenset(hashed.tolist()) for hashed in self.words]
        self.row = np.full(FEATURES, -1, np.int32)
        used = np.flatnonzero(known)
        self.row[used] = np.arange(len(used))
        # The last row stands for words that no item has.
        self.basis = np.vstack([basis.at(used) * idf[used, None], np.zeros((1, RANK))]).astype(np.float32)
        self.latent = np.array(latent, np.float32).reshape(-1, RANK)
        self.owner, self.offset = np.array(owner, np.int64), np.array(offset, np.int64)
        lengths = np.array([len(hashed) for hashed in self.words], np.int64)[self.owner]
        self.lengths = np.array([len(hashed) for hashed in self.words], np.int64)
        pairs = [(np.unique(self.row[(hashed & np.uint64(FEATURES - 1)).astype(np.int64)]), k) for k, hashed in enumerate(self.words)]
        # Words of an item beyond its different features.
        self.repeats = self.lengths - np.array([len(rows) for rows, _ in pairs], np.int64)
        # Marks of all pairs of an item and its words, sixteen places or more for each pair; other pairs may meet one too.
        self.shift = 32 - min(max(int(self.lengths.sum()) * 16 - 1, 1).bit_length(), 31)
        self.marks = np.zeros(1 << 32 - self.shift, bool)
        for rows, k in pairs:
            self.marks[self._mark(rows.astype(np.uint32) * _BY_ROW, np.uint64(k))] = True
        # All passages are met by windows of a passage, and items shorter than a passage also by windows of their own
        # length at every word, so that a whole item fills one.
        self.searches = [self._search(PASSAGE, DOC_STEP, np.arange(len(self.owner)), known)]
        for width in np.unique(lengths[lengths < PASSAGE]).tolist():
            own = np.zeros(FEATURES, bool)
            for hashed in self.words:
                if len(hashed) == width:
                    own[(hashed & np.uint64(FEATURES - 1)).astype(np.int64)] = True
            self.searches.append(self._search(width, 1, np.flatnonzero(lengths == width), own))

    def _search(self, width: int, step: int, passages: np.ndarray, known: np.ndarray) -> tuple:
        """(window, step, passages by falling size, their sizes, their words): the larger, the weaker a window it meets."""
        size = np.sqrt((self.latent[passages].astype(np.float64) ** 2).sum(1))
        order = np.argsort(-size, kind="stable")
        return width, step, passages[order], size[order], known

    def _mark(self, rows: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Places of the marks of words, given as their rows times _BY_ROW, and items."""
        return (rows + (items * np.uint64(_BY_ITEM)).astype(np.uint32)) >> np.uint32(self.shift)

    def candidates(self, sizes: np.ndarray, firsts: np.ndarray, feature: np.ndarray, row: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, item and highest cosine of each pair where some window is near a passage of the item, and the runs of
        places where the item would begin: the pair, the first and the last place of each."""
        squares = self.idf[feature] ** 2
        keys, places, cosines = [], [], []
        for width, step, passages, reach, known in self.searches:
            cuts = [_cut(n, step, width) if n else np.zeros(0, np.int64) for n in sizes]
            text = np.repeat(np.arange(len(sizes)), [len(c) for c in cuts])
            starts = np.concatenate(cuts) + firsts[text]
            ends = np.minimum(starts + width, (firsts + sizes)[text])
            whole = _spans(squares, starts, ends)
            # Repeats only add to a window's size, so its cosine without them is no lower.
            search = self._by_passage if len(passages) <= FEW else self._by_window
            window, at, product = search(row, squares, known[feature], starts, ends, whole, passages, reach)
            used, back = np.unique(window, return_inverse=True)
            cosine = product / np.sqrt(_sizes(feature, before, squares, starts[used], ends[used], width))[back]
            near = cosine >= COSINE
            window, passage = window[near], passages[at[near]]
            keys.append(text[window] * len(self.ids) + self.owner[passage])
            places.append(starts[window] - firsts[text[window]] - self.offset[passage])
            cosines.append(cosine[near])
        key, place, cosine = np.concatenate(keys), np.concatenate(places), np.concatenate(cosines)
        order = np.lexsort((place, key))
        key, place, cosine = key[order], place[order], cosine[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(heads):
            none = np.zeros(0, np.int64)
            return none, none, cosine, none, none, none
        text, item = np.divmod(key[heads], len(self.ids))
        tails = np.append(heads[1:], len(key))
        pair = np.repeat(np.arange(len(heads)), tails - heads)
        # A run holds the places within a passage of its first one; the next begins after it.
        shifted = place - place.min()
        line = pair * (shifted.max() + PASSAGE + 1) + shifted
        after = np.searchsorted(line, line + PASSAGE, "right")
        begins, at, ends = [], heads, tails
        while len(at):
            begins.append(at)
            more = after[at] < ends
            at, ends = after[at][more], ends[more]
        begin = np.sort(np.concatenate(begins))
        return text, item, np.maximum.reduceat(cosine, heads), pair[begin], place[begin], place[after[begin] - 1]

    def _by_passage(self, row, squares, mine, starts, ends, whole, passages, reach):
        """(window, passage, product) that may be near: each word's product with a passage, summed over windows."""
        found = []
        for k, scores in enumerate((self.basis @ self.latent[passages].T).T):
            product = _spans(scores[row].astype(np.float64), starts, ends)
            window = np.flatnonzero((product > 0) & (product >= LOOSE * np.sqrt(whole)))
            found.append((window, np.full(len(window), k), product[window]))
        return [np.concatenate(part) for part in zip(*found)]

    def _by_window(self, row, squares, mine, starts, ends, whole, passages, reach):
        """The same by the latent vectors of the windows, each with the passages that its size allows to be near."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        own, count = _spans(np.where(mine, squares, 0.0), starts, ends), _spans(mine.astype(np.float64), starts, ends)
        # A word's weight grows with its repeats, of which there are no more than known words.
        kept = np.flatnonzero((count > 0.5) & (count * own * reach[0] ** 2 >= LOOSE**2 * whole))
        latent, width = self.latent[passages], int((ends - starts).max(initial=1))
        for k in range(0, len(kept), 1024):
            some = kept[k : k + 1024]
            at = starts[some, None] + np.arange(width)
            words = np.where(at < ends[some, None], row[np.minimum(at, len(row) - 1)], len(self.basis) - 1)
            z = np.empty((len(some), RANK), np.float32)
            for j in range(0, len(some), WINDOWS):
                self.basis.take(words[j : j + WINDOWS], 0).sum(1, out=z[j : j + WINDOWS])
            # No cosine exceeds the product of the sizes of the two parts.
            bound = np.sqrt((z.astype(np.float64) ** 2).sum(1) / whole[some])
            order = np.argsort(-bound)
            for j in range(0, len(order), 64):
                block = order[j : j + 64]
                met = int(np.searchsorted(-reach, -LOOSE / max(bound[block[0]], 1e-300), side="right"))
                if not met:
                    break
                product = z[block] @ latent[:met].T
                i, p = np.nonzero(product >= (LOOSE * np.sqrt(whole[some[block]]))[:, None])
                found.append((some[block[i]], p, product[i, p].astype(np.float64)))
        return [np.concatenate(part) for part in zip(*found)]

    def leaks(self, texts: list[np.ndarray]) -> list[list[tuple[int, float, int, int, float]]]:
        """(item id, cosine, words in order, item words, share of the answer) of each item found, text by text."""
        out: list[list[tuple[int, float, int, int, float]]] = [[] for _ in texts]
        if not len(self.latent) or not texts:
            return out
        sizes = np.array([len(hashed) for hashed in texts])
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        feature = (np.concatenate(texts) & np.uint64(FEATURES - 1)).astype(np.int64)
        row = self.row[feature]
        row[row < 0] = len(self.basis) - 1
        before = _before(feature)
        text, item, cosine, pair, first, last = self.candidates(sizes, firsts, feature, row, before)
        owner = item[pair]
        slack = PASSAGE // 2 + self.lengths[owner] // 4
        begins = np.minimum(np.maximum(first - slack, 0), sizes[text[pair]])
        ends = np.maximum(np.minimum(last + self.lengths[owner] + slack, sizes[text[pair]]), begins)
        hits = self._hits(row, before, firsts[text[pair]] + begins, ends - begins, owner)
        able = np.flatnonzero(hits + self.repeats[owner] >= LCS_LIKELY * self.lengths[owner])
        found: dict[int, tuple[int, float]] = {}
        for k, begin, end in zip(pair[able].tolist(), begins[able].tolist(), ends[able].tolist()):
            words, answer, own = self.words[item[k]], self.answers[item[k]], self.sets[item[k]]
            part, least = texts[text[k]][begin:end], LCS_LIKELY * len(words)
            there = own.intersection(part.tolist())
            # Words that the item repeats count each time.
            if len(there) + len(words) - len(own) >= least and sum(w in there for w in words.tolist()) >= least:
                told = lcs(answer, part) / len(answer) if len(answer) else 0.0
                found[k] = max(found.get(k, (0, 0.0)), (lcs(words, part), told))
        for k, (common, told) in found.items():
            n = len(self.words[item[k]])
            share = common / n
            if share >= LCS_SURE or share >= LCS_LIKELY and told >= ANSWER:
                out[text[k]].append((self.ids[item[k]], float(cosine[k]), common, n, told))
        return [sorted(leaks) for leaks in out]

    def _hits(self, row: np.ndarray, before: np.ndarray, starts: np.ndarray, lengths: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Different features of each part that may be the item's, no fewer than are."""
        keys, items = row.astype(np.uint32) * _BY_ROW, items.astype(np.uint64)
        out, total, at = np.zeros(len(starts), np.int64), np.cumsum(lengths), 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
            some = lengths[at:end]
            tails = np.cumsum(some)
            places = np.arange(tails[-1]) + np.repeat(starts[at:end] - (tails - some), some)
            counted = self.marks[self._mark(keys[places], np.repeat(items[at:end], some))]
            counted &= before[places] < np.repeat(starts[at:end], some)
            marked = np.zeros(tails[-1] + 1, np.int64)
            np.cumsum(counted, out=marked[1:])
            out[at:end] = marked[tails] - marked[tails - some]
            at = end
        return out


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values from each start to its end."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[ends] - sums[starts]


def _before(feature: np.ndarray) -> np.ndarray:
    """Of each word the place of the one before it that has its feature, -1 where there is none."""
    order = np.argsort(feature.astype(np.uint16), kind="stable")
    order = order[np.argsort((feature[order] >> 16).astype(np.uint16), kind="stable")]
    again = np.flatnonzero(feature[order[1:]] == feature[order[:-1]])
    out = np.full(len(feature), -1)
    out[order[again + 1]] = order[again]
    return out


def _sizes(feature: np.ndarray, before: np.ndarray, squares: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Squared lengths of windows as TF-IDF vectors: a word that occurs twice weighs twice as much."""
    out = np.zeros(len(starts))
    for k in range(0, len(starts), 1024):
        at = starts[k : k + 1024, None] + np.arange(width)
        real = at < ends[k : k + 1024, None]
        at = np.minimum(at, len(feature) - 1)
        weights = np.where(real, squares[at], 0.0)
        twice = np.flatnonzero((real & (before[at] >= starts[k : k + 1024, None])).any(1))
        here = np.where(real[twice], feature[at[twice]], -1).astype(np.int32)
        weights[twice] *= (here[:, :, None] == here[:, None, :]).view(np.uint8).sum(2, dtype=np.uint8)
        out[k : k + 1024] = weights.sum(1)
    return out


def last_sentence(text: str | None) -> str:
    """What follows the last sentence end inside a text: an item's answer where none is given."""
    body = (text or "").rstrip(" .!?\n\t。！？")
    return body[max(body.rfind(mark) for mark in ".!?\n。！？") + 1 :]


def fit(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", answer_col: str | None = None) -> list[Index]:
    """The benchmark's index in blocks of BLOCK_ITEMS items; document frequencies come from all ``docs``.

    Items without an id, without text, or of fewer than LEAST_WORDS words are not searched. Repeated ids are
    searched each. The benchmark is the stated query set: its items pass through the driver block by block.
    """
    rows, seen = document_frequencies(docs, text_col)
    idf = np.log((rows + 1) / (seen + 1)) + 1.0
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    items = items.where("item IS NOT NULL AND text IS NOT NULL")
    blocks = -(-items.count() // BLOCK_ITEMS)
    if blocks == 0:
        return []
    basis = latent_basis(items, idf)
    out = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text", "answer").collect()
        out.append(Index([tuple(r) for r in mine], idf, basis))
    return out


LEAK = "array<struct<item_id:long,cosine:double,lcs_words:int,item_words:int,answer_share:double>>"


def leak_column(spark: SparkSession, indexes: list[Index], text_col: str = "text") -> Column:
    """The benchmark items found in each whole text, ordered by id.

    Null and wordless texts hold none. Rows are judged one by one, so repeated rows agree; without a
    benchmark every row has an empty list.
    """
    parts = [_leak_column(spark, index, text_col) for index in indexes]
    return F.concat(*parts) if parts else F.array().cast(LEAK)


def _leak_column(spark: SparkSession, index: Index, text_col: str) -> Column:
    held = shared(spark, index)
    kinds = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_words", pa.int32()), ("item_words", pa.int32()), ("answer_share", pa.float64())]))
    names = ["item_id", "cosine", "lcs_words", "item_words", "answer_share"]

    def find(column: pa.Array) -> pa.Array:
        own, words, out = held(), Words(), []
        waiting: list[np.ndarray] = []
        size = 0
        for hashed in words.of(column.to_pylist()):
            waiting.append(hashed)
            size += len(hashed)
            if size > CHUNK // 2:
                out.extend(own.leaks(waiting))
                waiting, size = [], 0
        out.extend(own.leaks(waiting))
        return pa.array([[dict(zip(names, leak)) for leak in leaks] for leaks in out], kinds)

    return arrow_column(find, LEAK, text_col)


def without_leaks(docs: DataFrame, indexes: list[Index], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found."""
    return docs.where(F.size(leak_column(docs.sparkSession, indexes, text_col)) == 0)
