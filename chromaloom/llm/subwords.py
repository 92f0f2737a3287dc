"""Quality classifier on learned subword embeddings: hashed word and character n-gram vectors, averaged and softmaxed.

Features of a text are its words (runs without white space) and the byte n-grams of GRAMS lengths inside a
word, where the white space around a word counts as its border. Each is hashed to one of BUCKETS vectors. A
pair of neighbouring words has one of two vectors of its own: same or different.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_column, shared

BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4)
# Buckets of word pairs, beside the hashed ones.
SAME, DIFFERENT = BUCKETS, BUCKETS + 1
ROWS = BUCKETS + 2
# The model is fitted on about so many labelled documents, chosen by a hash of the id: a bounded sample.
FIT_DOCS = 3000
EPOCHS, RATE, SEED = 8, 4.0, 7
# Bytes whose features are computed at a time.
CHUNK = 1 << 18
BLANK = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK64 = (1 << 64) - 1


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier modulo 2^64 for a chunk, and of its inverse."""
    inverse = pow(int(_ODD), -1, 1 << 64)
    size = 2 * CHUNK
    up, down = np.full(size, _ODD, np.uint64), np.full(size, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Features:
    """Bucket numbers of all features of a buffer of texts, each between blanks."""

    def __init__(self) -> None:
        self.up, self.down = _powers()
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True

    def of(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(place of the first byte, bucket) of the words, their pairs and each n-gram length.

        ``bounds`` are the ends of the pieces in the buffer; no feature reaches over one.
        """
        gap = self.blank[data]
        wide = np.where(gap, np.uint8(BLANK), data).astype(np.uint64)
        out = []
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(wide * self.up[: len(data)], out=sums[1:])
        words = (sums[ends] - sums[starts]) * self.down[starts]
        out.append((starts, self._bucket(words)))
        piece = np.searchsorted(bounds, starts, "right")
        near = np.flatnonzero(piece[1:] == piece[:-1])
        out.append((starts[near + 1], np.where(words[near + 1] == words[near], SAME, DIFFERENT).astype(np.int32)))
        for n in GRAMS:
            size = max(len(data) - n + 1, 0)
            gram = np.zeros(size, np.uint64)
            for k in range(n):
                gram = (gram << np.uint64(8)) | wide[k : k + size]
            inner = np.zeros(size, bool)
            for k in range(1, n - 1):
                inner |= gap[k : k + size]
            at = np.flatnonzero(~inner & ~(gap[:size] & gap[n - 1 : n - 1 + size]))
            out.append((at, self._bucket(gram[at] + np.uint64(n << 40))))
        return out

    @staticmethod
    def _bucket(values: np.ndarray) -> np.ndarray:
        mixed = values * _ODD
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * _ODD) >> np.uint64(64 - 16)).astype(np.int32)


def _framed(text: str | None) -> Iterator[np.ndarray]:
    """A text between blanks, in pieces of at most about a chunk that end at white space where there is any."""
    data = b" " + (text or "").encode("utf-8", "replace") + b" "
    start = 0
    while len(data) - start > CHUNK:
        cut = data.rfind(b" ", start + 1, start + CHUNK)
        cut = cut if cut > start else start + CHUNK - 1
        yield np.frombuffer(data[start:cut] + b" ", np.uint8)
        start = cut
    yield np.frombuffer(data[start:], np.uint8)


class Model:
    """Vectors and output weights; a text's probability of label 1 is the softmax of its mean vector."""

    def __init__(self, vectors: np.ndarray, output: np.ndarray, bias: np.ndarray):
        # The mean commutes with the output layer, so scoring needs one number a bucket.
        self.logit = (vectors @ (output[1] - output[0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def score(self, texts: list[str | None]) -> np.ndarray:
        features = Features()
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        pieces: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            if not pieces:
                return
            lengths = np.array([len(p) for p in pieces])
            bounds = np.cumsum(lengths)
            own = np.array(owners)
            for at, bucket in features.of(np.concatenate(pieces), bounds):
                row = own[np.searchsorted(bounds, at, "right")]
                sums[:] += np.bincount(row, self.logit[bucket], len(texts))
                counts[:] += np.bincount(row, minlength=len(texts))
            pieces.clear()
            owners.clear()

        held = 0
        for row, text in enumerate(texts):
            for piece in _framed(text):
                if held + len(piece) > CHUNK + 2:
                    flush()
                    held = 0
                pieces.append(piece)
                owners.append(row)
                held += len(piece)
        flush()
        return 1 / (1 + np.exp(-(self.bias + sums / np.maximum(counts, 1))))


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output weights and bias after stochastic gradient descent, one document a step."""
    rng, features, rows = np.random.default_rng(SEED), Features(), []
    for text in texts:
        counts = np.zeros(ROWS, np.float32)
        for piece in _framed(text):
            for _, bucket in features.of(piece, np.array([len(piece)])):
                counts += np.bincount(bucket, minlength=ROWS)
        used = np.flatnonzero(counts)
        rows.append((used, counts[used] / max(counts.sum(), 1)))
    vectors = ((rng.random((ROWS, DIM), np.float32) - 0.5) / DIM).astype(np.float32)
    output, bias = ((rng.random((2, DIM)) - 0.5) / DIM).astype(np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            rate = np.float32(RATE * (1 - step / steps))
            used, weight = rows[k]
            mean = weight @ vectors[used]
            raw = output @ mean + bias
            raw = np.exp(raw - raw.max())
            error = raw / raw.sum()
            error[labels[k]] -= 1
            back = error @ output
            output -= rate * np.outer(error, mean).astype(np.float32)
            bias -= np.float32(0.1) * rate / RATE * error
            # The mean's own weights make steps tiny on long texts; the scale keeps a step's effect on the text alike.
            vectors[used] -= (rate / max(float(weight @ weight), 1e-6) * 0.02) * weight[:, None] * back[None, :]
            step += 1
    return vectors, output, bias


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model | None:
    """The model of a bounded sample of labelled documents; None where no label is given.

    A document's label is 1 if at least half of its non-null labels are. Training is sequential and runs in
    one task on the sample alone, about FIT_DOCS documents whatever the number of labels.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    total = known.count()
    if total == 0:
        return None
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    chosen = known.where(place < min(1.0, FIT_DOCS / total))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(chosen, "id").select("id", "text", "label", F.lit(0).alias("all"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "text"])
        out = io.BytesIO()
        np.savez(out, *train(rows["text"].tolist(), rows["label"].to_numpy()))
        return pd.DataFrame({"model": [out.getvalue()]})

    learned = sample.groupBy("all").applyInPandas(learn, "model binary").collect()
    if not learned:
        return None
    arrays = np.load(io.BytesIO(bytes(learned[0]["model"])))
    return Model(*[arrays[f"arr_{k}"] for k in range(3)])


def score_column(spark: SparkSession, model: Model | None, text_col: str = "text") -> Column:
    """Probability of label 1 from the whole text.

    Null texts count as empty; an empty text has no features and gets the bias's probability. Without a
    model every score is 0.5. Equal texts get equal scores; an empty table gives an empty result.
    """
    held = shared(spark, model)

    def predict(column: pa.Array) -> pa.Array:
        own, texts = held(), column.to_pylist()
        scores = [own.score(texts[k : k + 512]) if own else np.full(len(texts[k : k + 512]), 0.5) for k in range(0, len(texts), 512)]
        return pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())

    return arrow_column(predict, "double", text_col)
