"""Phrase collocations from depth-truncated suffix subtrees, built in groups of word prefixes of bounded size.

Every word of a piece starts a suffix of at most LONGEST words. Prefixes are counted level by level: one that
occurs more often than a part of the group budget allows is extended by a word, so that every other prefix fits
a group. The suffixes of a group form its subtree: sorted leaves with the depths at which neighbours part. The
count of a phrase is the sum of the leaf totals below its node.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromaloom.llm.common import shared
from chromaloom.operators.skew import join_unique
from chromaloom.session import materialise, small_side

LONGEST, LEAST, BEST = 5, 100, 2000
# A phrase is dropped if a longer one that holds it has this percentage of its count.
KEPT_PERCENT = 100
# Leaves of a group on average at most twice the sum of; a prefix of more than half of it is extended.
GROUP_LEAVES = 1 << 19
# Prefixes that may be extended, over all levels: beyond LISTED x GROUP_LEAVES words, groups grow instead.
LISTED = 200_000
# Words that tasks know by number; the others keep their text.
KNOWN_WORDS = 500_000
# Frequent pairs that tasks know: a suffix then ends before an infrequent one. Beyond, suffixes keep their length.
KNOWN_PAIRS = 1_000_000
# Bytes of text and words handled at a time, and distinct words counted before they are passed on.
SLICE, BLOCK, FLUSH_WORDS = 1 << 22, 1 << 19, 1 << 17
# Distinct suffixes that a task gathers before it passes them on.
GATHERED = 1 << 20
# Rows of one output batch, and rows that one task ranks.
BATCH, RANKED = 1 << 16, 1 << 17

# A piece ends at these characters; inside the program a full stop stands for all of them.
STOP = b"."
PLAIN = bytes(ord(STOP) if chr(k) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if chr(k) == "\t" else k for k in range(256))


def _slices(data: bytes) -> Iterator[bytes]:
    """Parts of a text of about SLICE bytes, cut at blanks or stops only."""
    at = 0
    while len(data) - at > SLICE:
        cut = _CUT.search(data, at + SLICE)
        if cut is None:
            break
        yield data[at : cut.start()]
        # The blank or stop opens the next part, as a stop must not get lost.
        at = cut.start()
    yield data[at:]


_CUT = re.compile(rb"[ .]")


def _words(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Lower-cased words of the texts, with STOP between pieces and texts."""
    data = STOP.join(texts).lower().translate(PLAIN)
    for part in _slices(data):
        yield part.replace(STOP, b" . ").split()


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, about SLICE bytes or one text at a time; (lang, text) are the batches' columns."""
    waiting: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if text:
                waiting.setdefault(lang, []).append(text)
                size += len(text)
                if size > SLICE:
                    yield from waiting.items()
                    waiting, size = {}, 0
    yield from waiting.items()


def _texts(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string(), safe=False)


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, c) over (lang, text), summed in tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counter in seen.items():
                counter.pop(STOP, None)
                words, counts = _texts(list(counter)), pa.array(counter.values(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, counts], ["lang", "word", "c"])

        for lang, own in _by_lang(batches):
            counter = seen.setdefault(lang, Counter())
            for words in _words(own):
                counter.update(words)
            if sum(map(len, seen.values())) > FLUSH_WORDS:
                yield from rows()
                seen.clear()
        yield from rows()

    partial = texts.mapInArrow(count, "lang string, word string, c long")
    return partial.groupBy("lang", "word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Numbers (from 1) of known words by language. ``complete``: every other word is too rare for a phrase.

    ``pairs`` are the sorted keys of all pairs of words that a phrase can hold, if they are known.
    """

    def __init__(self, words: dict[str, list[bytes]], counts: dict[str, list[int]], complete: bool):
        self.words, self.counts, self.complete = words, counts, complete
        self.places: dict[str, dict[bytes, int]] = {}
        self.pairs: dict[str, np.ndarray] | None = None

    def place(self, lang: str) -> dict[bytes, int]:
        if lang not in self.places:
            self.places[lang] = {word: k for k, word in enumerate(self.words.get(lang, []), 1)}
        return self.places[lang]

    def learn_pairs(self, table: pa.Table) -> None:
        """Take in all frequent pairs, (lang, phrase)."""
        self.pairs = {lang: np.empty(0, np.int64) for lang in self.words}
        for lang in self.words:
            own = table.filter(pc.equal(table["lang"], lang))["phrase"].combine_chunks()
            names, both = _texts(self.words[lang]), pc.split_pattern(own, " ")
            first, second = (pc.index_in(pc.list_element(both, k), names).to_numpy().astype(np.int64) + 1 for k in (0, 1))
            self.pairs[lang] = np.sort(first << 32 | second)

    def count(self, lang: str, word: bytes) -> int | None:
        """How often a known word occurs."""
        at = self.place(lang).get(word)
        return None if at is None else self.counts[lang][at - 1]

    def joined(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """Whether a phrase can go on from each word to the next."""
        on = (ids[:-1] != 0) & (ids[1:] != 0)
        if self.pairs is not None:
            keys = self.pairs.get(lang, ())
            if not len(keys):
                return np.zeros(len(ids), bool)
            key = ids[:-1].astype(np.int64) << 32 | ids[1:]
            on &= keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
        return np.append(on, False)

    def numbers(self, lang: str, texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Word numbers of the texts, 0 where a phrase has to end, and the words by number."""
        names = self.words.get(lang, [])
        place, found = self.place(lang), []
        if self.complete:
            for words in _words(texts):
                found.append(np.fromiter(map(place.get, words, repeat(0)), np.int32, len(words)))
        else:
            place, names = {**place, STOP: 0}, list(names)
            for words in _words(texts):
                for word in set(words) - place.keys():
                    names.append(word)
                    place[word] = len(names)
                found.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        return np.concatenate(found), names


class Heavy:
    """Counts of the prefixes that are extended, by language and depth; the prefixes are tuples of words."""

    def __init__(self) -> None:
        self.counts: dict[str, list[dict[tuple[bytes, ...], int]]] = {}

    def add(self, lang: str, prefix: tuple[bytes, ...], count: int) -> None:
        levels = self.counts.setdefault(lang, [{} for _ in range(LONGEST)])
        levels[len(prefix) - 1][prefix] = count

    def any_at(self, depth: int) -> bool:
        return any(levels[depth - 1] for levels in self.counts.values())

    def tree(self, lang: str, names: list[bytes]) -> list[np.ndarray]:
        """By depth, sorted keys (place of the parent among its level's keys, number of the word)."""
        place = {word: k for k, word in enumerate(names, 1)}
        levels, parents = [], {(): 0}
        for prefixes in self.counts.get(lang, []):
            known = [p for p in prefixes if p[:-1] in parents and p[-1] in place]
            keys = sorted((parents[p[:-1]] << 32 | place[p[-1]], p) for p in known)
            levels.append(np.array([k for k, _ in keys], np.int64))
            parents = {p: k for k, (_, p) in enumerate(keys)}
        return levels

    def count(self, lang: str, prefix: tuple[bytes, ...]) -> int | None:
        levels = self.counts.get(lang)
        return levels[len(prefix) - 1].get(prefix) if levels else None


def _suffixes(lexicon: Lexicon, lang: str, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Matrices (LONGEST x starts) of word numbers, 0 after the end of a suffix."""
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK + LONGEST - 1]
        size = min(BLOCK, len(ids) - at)
        goes_on = lexicon.joined(lang, part)
        suffix = np.zeros((LONGEST, size), np.int32)
        suffix[0] = part[:size]
        inside = np.ones(size, bool)
        for d in range(1, LONGEST):
            later = part[d : d + size]
            inside[len(later) :] = False
            inside[: len(later)] &= goes_on[d - 1 : d - 1 + len(later)]
            suffix[d, : len(later)] = np.where(inside[: len(later)], later, 0)
        yield suffix[:, suffix[0] != 0]


def _descend(suffix: np.ndarray, tree: list[np.ndarray], depth: int) -> np.ndarray:
    """Length of each suffix's longest extended prefix of at most ``depth`` words."""
    count = suffix.shape[1]
    node, length = np.zeros(count, np.int64), np.zeros(count, np.int8)
    inside = np.ones(count, bool)
    for d, keys in enumerate(tree[:depth]):
        if not len(keys):
            break
        key = node << 32 | suffix[d]
        at = np.searchsorted(keys, key)
        inside &= keys[np.minimum(at, len(keys) - 1)] == key
        node = np.where(inside, at, node)
        length += inside
    return length


def _merged(suffix: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes and how often each occurs, or the sum of its weights."""
    head = suffix[0].astype(np.int64) << 32 | suffix[1]
    middle = suffix[2].astype(np.int64) << 32 | suffix[3]
    order = np.lexsort((suffix[4], middle, head))
    head, middle, last = head[order], middle[order], suffix[4][order]
    new = np.ones(len(order), bool)
    new[1:] = (head[1:] != head[:-1]) | (middle[1:] != middle[:-1]) | (last[1:] != last[:-1])
    starts = np.flatnonzero(new)
    distinct = suffix[:, order[starts]]
    if weights is None or not len(starts):
        return distinct, np.diff(np.append(starts, len(order)))
    return distinct, np.add.reduceat(weights[order], starts)


def _gathered(
    lexicon: Lexicon, found: Iterator[tuple[str, list[bytes], np.ndarray]]
) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """Suffixes by language, merged over a whole task where it holds at most GATHERED; (lang, names, suffixes, counts).

    Unknown words have numbers of their block only, so with such words each block goes on by itself.
    """
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        return _merged(np.hstack([x for x, _ in held[lang]]), np.concatenate([c for _, c in held[lang]]))

    for lang, names, suffix in found:
        distinct, counts = _merged(suffix)
        if not lexicon.complete:
            yield lang, names, distinct, counts
            continue
        held.setdefault(lang, []).append((distinct, counts))
        size += len(counts)
        if size > GATHERED:
            held = {own: [merged(own)] for own in held}
            size = sum(len(blocks[0][1]) for blocks in held.values())
            if size > GATHERED // 2:
                for own, blocks in held.items():
                    yield own, lexicon.words.get(own, []), *blocks[0]
                held, size = {}, 0
    for lang in held:
        yield lang, lexicon.words.get(lang, []), *merged(lang)


def _phrases(suffix: np.ndarray, names: pa.Array) -> pa.Array:
    """The words of each column, joined by blanks."""
    parts = [names.take(pa.array(row - 1, mask=row == 0)) for row in suffix]
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def _batches(lang: str, columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    size = len(columns[0])
    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(size, np.int32)))
    whole = pa.RecordBatch.from_arrays([langs, *columns], ["lang", *names])
    for at in range(0, size, BATCH):
        yield whole.slice(at, BATCH)


def _extensions(texts: DataFrame, lexicon: Lexicon, heavy: Heavy, depth: int) -> DataFrame:
    """(lang, phrase, c) of the prefixes of ``depth`` words whose first words are an extended prefix.

    Of two words, all prefixes are counted if all words are known, as their counts also tell where suffixes end.
    """
    held = shared(texts.sparkSession, (lexicon, heavy))

    def chosen(
        known: Lexicon, listed: Heavy, batches: Iterator[pa.RecordBatch]
    ) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang, own in _by_lang(batches):
            ids, names = known.numbers(lang, own)
            tree = listed.tree(lang, names)
            every = depth == 2 and known.complete
            if not every and (len(tree) < depth - 1 or not len(tree[depth - 2])):
                continue
            for suffix in _suffixes(known, lang, ids):
                suffix = suffix[:, suffix[depth - 1] != 0]
                if not every:
                    suffix = suffix[:, _descend(suffix, tree, depth - 1) == depth - 1]
                suffix[depth:] = 0
                yield lang, names, suffix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, listed = held()
        for lang, names, distinct, counts in _gathered(known, chosen(known, listed, batches)):
            yield from _batches(lang, [_phrases(distinct, _texts(names)), pa.array(counts, pa.int64())], ["phrase", "c"])

    partial = texts.mapInArrow(count, "lang string, phrase string, c long")
    return partial.groupBy("lang", "phrase").agg(F.sum("c").alias("c"))


def _leaves(texts: DataFrame, lexicon: Lexicon, heavy: Heavy, groups: int) -> DataFrame:
    """(group, lang, phrases, roots, counts): the suffixes of a group that one task has gathered, in one row.

    The group is a hash of a suffix's root: its shortest prefix that is not extended. A suffix that ends as an
    extended prefix, or as one word where all words are counted, is left out, as its prefixes are counted already.
    """
    held = shared(texts.sparkSession, (lexicon, heavy))

    def starts(known: Lexicon, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        for lang, own in _by_lang(batches):
            ids, names = known.numbers(lang, own)
            for suffix in _suffixes(known, lang, ids):
                yield lang, names, suffix[:, suffix[1] != 0] if known.complete else suffix

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, listed = held()
        for lang, names, suffix, counts in _gathered(known, starts(known, batches)):
            length = _descend(suffix, listed.tree(lang, names), LONGEST - 1)
            goes_on = suffix[length, np.arange(len(length))] != 0
            suffix, counts, length = suffix[:, goes_on], counts[goes_on], length[goes_on]
            if not len(counts):
                continue
            shown = _texts(names)
            root = np.where(np.arange(LONGEST)[:, None] <= length, suffix, 0)
            # Suffixes are in order, so those of one root stand together.
            first = np.flatnonzero(np.append(True, (root[:, 1:] != root[:, :-1]).any(0)))
            hashed = [xxhash.xxh64_intdigest(f"{lang}\t{text}") % groups for text in _phrases(root[:, first], shown).to_pylist()]
            group = np.repeat(np.array(hashed, np.int64), np.diff(np.append(first, len(counts))))
            order = np.argsort(group, kind="stable")
            group = group[order]
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = pa.array(np.append(cuts, len(group)).astype(np.int32))
            lists = [_phrases(suffix[:, order], shown), pa.array(length[order].astype(np.int32) + 1), pa.array(counts[order].astype(np.int64))]
            made = [pa.array(group[cuts]), *(pa.ListArray.from_arrays(ends, column) for column in lists)]
            yield from _batches(lang, made, ["group", "phrases", "roots", "counts"])

    schema = "lang string, group long, phrases array<string>, roots array<int>, counts array<long>"
    return texts.mapInArrow(spread, schema)


def subtree(rows: pa.Table, least: int, counted: int, ancestor: Callable[[str, tuple[bytes, ...]], int | None]) -> pa.Table:
    """Nodes of a group's subtree: (lang, phrase, depth, c, lefts) of the phrases that occur ``least`` times or more.

    ``rows`` hold leaves (lang, phrases, roots, counts), equal ones possibly several times. ``lefts`` are the counts
    of the phrase's first 1, 2, ... words. Those of up to ``counted`` words and those above the leaves' roots were
    counted before; they come from ``ancestor`` and give no node here.
    """
    langs = rows["lang"].combine_chunks().dictionary_encode()
    lists = rows["phrases"].combine_chunks()
    split = pc.split_pattern(lists.flatten(), " ")
    lengths = pc.list_value_length(split).to_numpy()
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary
    matrix = np.zeros((LONGEST, len(split)), np.int32)
    matrix.T[np.arange(LONGEST)[None, :] < lengths[:, None]] = coded.indices.to_numpy() + 1
    owner = np.repeat(langs.indices.to_numpy(), pc.list_value_length(lists).to_numpy())
    weights = rows["counts"].combine_chunks().flatten().to_numpy()
    roots = np.maximum(rows["roots"].combine_chunks().flatten().to_numpy(), counted + 1)
    order = np.lexsort((*matrix[::-1], owner))
    matrix, owner, weights, roots = matrix[:, order], owner[order], weights[order], roots[order]
    # Where neighbouring leaves part: at this depth a new node starts.
    parts = np.ones(len(order), bool)
    parts[1:] = owner[1:] != owner[:-1]
    totals = np.zeros((LONGEST, len(order)), np.int64)
    found = []
    for d in range(LONGEST):
        parts[1:] |= matrix[d, 1:] != matrix[d, :-1]
        starts = np.flatnonzero(parts)
        sums = np.add.reduceat(weights, starts)
        totals[d] = np.repeat(sums, np.diff(np.append(starts, len(order))))
        shown = starts[(sums >= least) & (matrix[d, starts] != 0) & (roots[starts] <= d + 1)]
        found.append(shown)
    pieces = []
    for d, shown in enumerate(found):
        path = matrix[: d + 1, shown]
        phrases = _phrases(path, words)
        lefts = totals[:d, shown].T.copy()
        for k in np.flatnonzero(roots[shown] > 1):
            first = tuple(phrases[int(k)].as_py().encode().split(b" "))
            lang = langs.dictionary[int(owner[shown[k]])].as_py()
            for above in range(1, min(int(roots[shown[k]]) - 1, d) + 1):
                lefts[k, above - 1] = ancestor(lang, first[:above])
        ends = pa.array(np.arange(len(shown) + 1, dtype=np.int32) * d)
        columns = [
            langs.dictionary.take(pa.array(owner[shown])),
            phrases,
            pa.array(np.full(len(shown), d + 1, np.int32)),
            pa.array(totals[d, shown]),
            pa.ListArray.from_arrays(ends, pa.array(lefts.ravel(), pa.int64())),
        ]
        pieces.append(pa.table(columns, ["lang", "phrase", "depth", "c", "lefts"]))
    return pa.concat_tables(pieces)


NODES = "lang string, phrase string, depth int, c long, lefts array<long>"


def phrase_counts(texts: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, depth, c, lefts) of all phrases of 1 to LONGEST words that occur ``least`` times or more.

    ``texts`` is (lang, text), ``words`` their counted words (written). Words below ``least`` end a suffix, as
    no phrase can hold them. The driver and every task hold at most KNOWN_WORDS words and about LISTED prefixes.
    """
    spark = texts.sparkSession
    frequent = words.where(F.col("c") >= least)
    sizes = frequent.groupBy("c").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("c", ascending=False)
    if sizes.empty:
        return spark.createDataFrame([], NODES)
    fitting = sizes[sizes["n"].cumsum() <= KNOWN_WORDS]
    complete = len(fitting) == len(sizes)
    known = frequent.where(F.col("c") >= (int(fitting["c"].min()) if len(fitting) else np.iinfo(np.int64).max))
    table = known.toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    names: dict[str, list[bytes]] = {}
    own_counts: dict[str, list[int]] = {}
    for lang, word, c in zip(table["lang"].to_pylist(), table["word"].cast(pa.binary()).to_pylist(), table["c"].to_pylist()):
        names.setdefault(lang, []).append(word)
        own_counts.setdefault(lang, []).append(c)
    lexicon = Lexicon(names, own_counts, complete)
    total = int((frequent if complete else words).agg(F.sum("c")).first()[0])
    budget = max(GROUP_LEAVES, -(-2 * total * LONGEST // LISTED))
    heavy, level = Heavy(), words.select("lang", F.col("word").alias("phrase"), "c")
    listed = []
    for depth in range(1, LONGEST):
        if depth > 1:
            level = _extensions(texts, lexicon, heavy, depth)
        if depth == 2 and complete:
            level = materialise(level.where(F.col("c") >= min(least, budget // 2)), "pairs")
            pairs = level.where(F.col("c") >= least)
            if pairs.count() <= KNOWN_PAIRS:
                lexicon.learn_pairs(pairs.select("lang", "phrase").toArrow())
        for row in level.where(F.col("c") > budget // 2).collect():
            prefix = tuple(row.phrase.encode().split(b" "))
            if depth > 1 and heavy.count(row.lang, prefix[:-1]) is None:
                continue
            lefts = [heavy.count(row.lang, prefix[:k]) for k in range(1, depth)]
            listed.append((row.lang, row.phrase, depth, row.c, lefts))
            heavy.add(row.lang, prefix, row.c)
        if not heavy.any_at(depth) and (depth > 1 or not complete):
            break
    groups = max(1, -(-2 * total // budget))
    leaves = _leaves(texts, lexicon, heavy, groups)
    held = shared(spark, (lexicon, heavy))
    # Where every frequent word is known, words are not counted again.
    counted = 1 if complete else 0

    def build(rows: pa.Table) -> pa.Table:
        known, listed = held()

        def ancestor(lang: str, prefix: tuple[bytes, ...]) -> int | None:
            return known.count(lang, prefix[0]) if len(prefix) <= counted else listed.count(lang, prefix)

        return subtree(rows, least, counted, ancestor)

    nodes = leaves.groupBy("group").applyInArrow(build, NODES)
    if complete:
        alone = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("depth"), "c", F.array().cast("array<long>").alias("lefts"))
        nodes = nodes.unionByName(alone)
        listed = [row for row in listed if row[2] > 1]
    if listed:
        nodes = nodes.unionByName(spark.createDataFrame(listed, NODES).where(F.col("c") >= least))
    return nodes


def _scored(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two or more words, by their lowest-scoring cut."""
    rest = F.expr(
        "transform(sequence(1, depth - 1), "
        "k -> struct(k AS k, lefts[k - 1] AS l, substring_index(phrase, ' ', k - depth) AS rest))"
    )
    longer = nodes.where("depth > 1")
    cuts = longer.select("lang", F.col("phrase").alias("whole"), F.col("c").alias("a"), F.explode(rest).alias("cut"))
    cuts = cuts.select("lang", "whole", "a", "cut.k", "cut.l", F.col("cut.rest").alias("phrase"))
    met = join_unique(cuts, nodes.select("lang", "phrase", F.col("c").alias("r")), ["lang", "phrase"])
    met = met.join(small_side(totals)[0], "lang")
    # Products of counts below 10^17 stay within 38 digits, and div is exact on decimals.
    wide = {c: f"CAST({c} AS DECIMAL(17,0))" for c in "anlr"}
    ratio = f"(1000BD * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})"
    met = met.withColumn("score", F.expr(ratio))
    least = F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("best")
    return met.groupBy("lang", F.col("whole").alias("phrase")).agg(least).select(
        "lang", "phrase", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    )


def _contained(nodes: DataFrame, kept_percent: int) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer phrase that holds the phrase's words in a row."""
    inner = F.expr(
        "flatten(transform(sequence(2, depth - 1), m -> transform(sequence(0, depth - m), "
        "at -> array_join(slice(split(phrase, ' '), at + 1, m), ' '))))"
    )
    held = nodes.where("depth > 2").select("lang", "c", F.explode(inner).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("c").alias("most"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", best: int = BEST, least: int = LEAST
) -> DataFrame:
    """The ``best`` phrases of 2 to LONGEST words of each language: (lang, rank, phrase, a, l, r, n, score).

    Counts go over all occurrences within pieces of the whole texts. Null and empty texts have no words, a null
    language counts as ``und``; repeated rows count each time; a language without a phrase gives no row, an empty
    table an empty result. Ties go to the higher count, then to the phrase that sorts first by its bytes. Other
    columns of ``docs`` are not looked at. The counted phrases, at most LONGEST in ``least`` of all words, are a
    written table; joins on them salt hot keys, and each language is ranked in parts before its last ranking.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = materialise(count_words(texts), "words")
    totals = materialise(words.groupBy("lang").agg(F.sum("c").alias("n")), "words-by-lang")
    nodes = materialise(phrase_counts(texts, words, least), "phrases")
    scored = _scored(nodes, totals)
    inside = _contained(nodes, KEPT_PERCENT)
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(KEPT_PERCENT) * F.col("a"))
    )
    kept = materialise(kept.drop("most"), "scored-phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    count = kept.count()
    if count > RANKED:
        parts = -(-count // RANKED)
        dealt = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        place = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
        kept = dealt.withColumn("_place", place).where(F.col("_place") <= best).drop("_part", "_place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
