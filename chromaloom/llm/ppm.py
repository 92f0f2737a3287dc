"""Language identification by partial matching: byte context trees with escapes, one for each language.

A tree holds the counts of every byte string up to ``order`` + 1 bytes in a language's training text. The
code length of a byte under its longest known context follows escape method C with exclusion: in a context
with n occurrences of d different bytes, a seen byte costs log2((n + d) / count), an escape to the next
shorter context costs log2((n + d) / d), and bytes already offered by the longer context no longer count
there. Below the empty context all bytes not offered are equally likely. Statistics are frozen after
training, so the lengths are those of a proper code and do not depend on what was read before.
"""

from __future__ import annotations

import io
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_column, shared

ORDER = 4
# The trees are fitted on about so many documents a language, chosen by a hash of the id, and on no more
# than so many bytes of them: a bounded sample, whatever the size of the table.
FIT_DOCS, FIT_BYTES = 300, 600_000
# Bytes scored at a time, and texts.
CHUNK, ROWS = 1 << 18, 256
UNDETERMINED = "und"
# A document whose best code is no shorter than its plain bytes is in none of the learned languages.
PLAIN_BITS = 8.0
# Texts start in the context of a line break.
PAD = 10


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def _grams(texts: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length 1 to order + 1: the packed byte strings that end at a byte of a text, and their counts."""
    pad = np.full(order, PAD, np.uint8)
    whole = np.concatenate([part for text in texts for part in (pad, _bytes(text))] or [pad])
    own = np.concatenate([part for text in texts for part in (np.zeros(order, bool), np.ones(len(_bytes(text)), bool))] or [np.zeros(order, bool)])
    packed, out = np.zeros(len(whole), np.uint64), []
    for back in range(order + 1):
        shifted = np.zeros(len(whole), np.uint64)
        shifted[back:] = whole[: len(whole) - back] if back else whole
        packed |= shifted << np.uint64(8 * back)
        out.append(np.unique(packed[own], return_counts=True))
    return out


class Trees:
    """The context trees of all languages laid over each other, as arrays indexed by node.

    Node 0 stands for unknown strings, node 1 for the empty one. ``step[node, symbol]`` is the string longer
    by one byte. A node has its counts for each language, and as a context n and d with and without exclusion.
    """

    def __init__(self, grams: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int):
        self.order, self.languages = order, sorted(grams)
        width = len(self.languages)
        keys = [np.unique(np.concatenate([grams[k][m][0] for k in self.languages])) for m in range(order + 1)]
        for m in range(order, 0, -1):  # prefixes are contexts, also where no text byte ends them
            keys[m - 1] = np.union1d(keys[m - 1], keys[m] >> np.uint64(8))
        first = np.cumsum([2] + [len(k) for k in keys])
        contexts = int(first[order])
        self.symbol = np.zeros(256, np.uint8)
        known = keys[0].astype(np.int64)
        self.symbol[known] = np.arange(1, len(known) + 1)
        self.step = np.zeros((contexts, len(known) + 1), np.int32)
        count = np.zeros((int(first[-1]), width), np.float32)
        suffix = np.zeros(int(first[-1]), np.int64)
        n, d = np.zeros((contexts, width)), np.zeros((contexts, width))
        n_ex, d_ex = np.zeros((contexts, width)), np.zeros((contexts, width))
        parents, ids = [], []
        for m in range(order + 1):
            node = first[m] + np.arange(len(keys[m]))
            parent = np.ones(len(node), np.int64) if m == 0 else first[m - 1] + np.searchsorted(keys[m - 1], keys[m] >> np.uint64(8))
            self.step[parent, self.symbol[(keys[m] & np.uint64(255)).astype(np.int64)]] = node
            for j, language in enumerate(self.languages):
                strings, counts = grams[language][m]
                count[first[m] + np.searchsorted(keys[m], strings), j] = counts
            if m == 0:
                suffix[node] = 1
            else:
                short = keys[m] & np.uint64((1 << (8 * m)) - 1)
                at = np.minimum(np.searchsorted(keys[m - 1], short), len(keys[m - 1]) - 1)
                suffix[node] = np.where(keys[m - 1][at] == short, first[m - 1] + at, 0)
            parents.append(parent)
            ids.append(node)
        for parent, node in zip(parents, ids):
            np.add.at(n, parent, count[node])
            np.add.at(d, parent, count[node] > 0)
            if parent[0] != 1:
                shared = np.where(count[node] > 0, count[suffix[node]], 0)
                np.add.at(n_ex, parent, shared)
        inner = np.arange(2, contexts)
        n_ex[inner] = n[np.minimum(suffix[inner], contexts - 1)] - n_ex[inner]
        d_ex[inner] = d[np.minimum(suffix[inner], contexts - 1)] - d[inner]
        self.count, self.n, self.d, self.n_ex, self.d_ex = count, n.astype(np.float32), d.astype(np.float32), n_ex.astype(np.float32), d_ex.astype(np.float32)
        # Where context and byte are known in full the cost depends on the node alone.
        self.first_full = int(first[order])
        full = ids[order]
        matches = [full]
        for _ in range(order):
            matches.append(suffix[matches[-1]])
        ends = [parents[order]]
        for _ in range(order):
            ends.append(suffix[ends[-1]])
        self.full_cost = self._lengths(ends[::-1], matches[::-1]).astype(np.float32)

    def _lengths(self, contexts: list[np.ndarray], matches: list[np.ndarray]) -> np.ndarray:
        """Bits for each place and language; contexts[j] and matches[j] are the nodes of the last j and j + 1 bytes."""
        cost = np.zeros((len(matches[0]), len(self.languages)))
        done, entered = np.zeros(cost.shape, bool), np.zeros(cost.shape, bool)
        longer = None
        for j in range(len(contexts) - 1, -1, -1):
            node = contexts[j]
            here = ~done & (self.d[node] > 0)
            n, d = self.n[node].astype(np.float64), self.d[node].astype(np.float64)
            if longer is not None:
                n, d = np.where(entered, self.n_ex[longer], n), np.where(entered, self.d_ex[longer], d)
            seen = self.count[matches[j]].astype(np.float64)
            hit = here & (seen > 0)
            miss = here & ~hit & (d > 0)
            cost[hit] += np.log2((n + d)[hit] / seen[hit])
            cost[miss] += np.log2((n + d)[miss] / d[miss])
            done |= hit
            entered |= here
            longer = node
        rest = np.log2(np.maximum(256.0 - self.d[1], 1.0))
        cost[~done] += np.broadcast_to(rest, cost.shape)[~done]
        return cost

    def lengths(self, text: np.ndarray) -> np.ndarray:
        """Bits for each byte after the first ``order`` (given context) and each language."""
        symbols = self.symbol[text]
        nodes = [np.ones(len(symbols) + 1, np.int32)]
        for _ in range(self.order + 1):
            longer = np.zeros(len(symbols) + 1, np.int32)
            longer[1:] = self.step[nodes[-1][:-1], symbols]
            # Strings of full length are no contexts: as one, they would step from beyond the table.
            nodes.append(longer)
        skip = self.order
        deepest = nodes[-1][skip + 1 :]
        bits = self.full_cost[np.maximum(deepest - self.first_full, 0)]
        odd = np.flatnonzero(deepest == 0)
        if len(odd):
            at = odd + skip
            bits[odd] = self._lengths([nodes[j][at] for j in range(self.order + 1)], [nodes[j + 1][at + 1] for j in range(self.order + 1)])
        return bits

    def score(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text under each language."""
        total = np.zeros((len(texts), len(self.languages)))
        pieces: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        held = 0

        def flush() -> None:
            nonlocal pieces, owners, held
            if pieces:
                bits = self.lengths(np.concatenate(pieces))
                at = 0
                for row, size in owners:
                    total[row] += bits[at : at + size].sum(0, dtype=np.float64)
                    at += size + self.order
            pieces, owners, held = [], [], 0

        for row, text in enumerate(texts):
            data = np.concatenate([np.full(self.order, PAD, np.uint8), _bytes(text)])
            for start in range(0, len(data) - self.order, CHUNK):
                piece = data[start : start + CHUNK + self.order]
                pieces.append(piece)
                owners.append((row, len(piece) - self.order))
                held += len(piece)
                if held >= CHUNK:
                    flush()
        flush()
        return total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Trees | None:
    """The trees of every language of the labelled documents, or None if none is labelled.

    Documents are chosen by a hash of id and text, at a rate from the language's count. One task counts the
    strings of one language's sample; what comes to the driver is at most FIT_BYTES x (ORDER + 1) strings each.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    rates = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rates = {row["lang"]: min(1.0, FIT_DOCS / row["n"]) for row in rates.collect()}
    if not rates:
        return None
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    place = F.shiftrightunsigned(F.xxhash64("id", F.octet_length("text")), 11) / F.lit(float(1 << 53))
    sample = known.where(place < rate).select("lang", "text", place.alias("place"))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "text"])
        texts, room = [], FIT_BYTES
        for text in rows["text"]:
            texts.append(text[: max(room, 0)])
            room -= len(text)
            if room <= 0:
                break
        out = io.BytesIO()
        np.savez(out, *[a for pair in _grams(texts, ORDER) for a in pair])
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "grams": [out.getvalue()]})

    counted = sample.groupBy("lang").applyInPandas(count, "lang string, grams binary").collect()
    grams = {}
    for row in counted:
        loaded = np.load(io.BytesIO(bytes(row["grams"])))
        arrays = [loaded[f"arr_{k}"] for k in range(2 * (ORDER + 1))]
        grams[row["lang"]] = list(zip(arrays[::2], arrays[1::2]))
    return Trees(grams, ORDER) if grams else None


def judge(spark: SparkSession, trees: Trees | None, text_col: str = "text") -> Column:
    """Struct (lang_pred, score, bits_per_byte) of a whole text.

    ``score`` is the language's share of the probability that all languages give the text (1 / sum of
    2^-(extra bits)). ``und`` with score 0 and no bits for null texts, texts without a letter, and where
    no language was learned. Ties go to the language that sorts first. Rows are judged one by one, so
    repeated rows agree. The trees are broadcast; FIT_DOCS and FIT_BYTES bound their size.
    """
    held = shared(spark, trees)

    def predict(column: pa.Array) -> pa.Array:
        model, texts = held(), column.to_pylist()
        judged = [k for k, text in enumerate(texts) if model and text and any(map(str.isalpha, text))]
        names, scores, rates = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
        for start in range(0, len(judged), ROWS):
            block = judged[start : start + ROWS]
            bits = model.score([texts[k] for k in block])
            best = bits.argmin(1)
            share = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
            for row, k in enumerate(block):
                names[k] = model.languages[best[row]]
                scores[k] = float(share[row])
                rates[k] = float(bits[row, best[row]] / len(_bytes(texts[k])))
        arrays = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
        return pa.StructArray.from_arrays(arrays, ["lang_pred", "score", "bits_per_byte"])

    return arrow_column(predict, "lang_pred string, score double, bits_per_byte double", text_col)


def identify(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte of ``judge``; columns of these names are replaced."""
    made = ["lang_pred", "score", "bits_per_byte"]
    judged = docs.drop(*made).withColumn("_judged", judge(docs.sparkSession, trees, text_col))
    return judged.select(*[c for c in docs.columns if c not in made], "_judged.*")


def in_known_language(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a learned language: not ``und``, and coded shorter than their plain bytes."""
    judged = docs.withColumn("_judged", judge(docs.sparkSession, trees, text_col))
    return judged.where((F.col("_judged.lang_pred") != UNDETERMINED) & (F.col("_judged.bits_per_byte") < PLAIN_BITS)).drop("_judged")
