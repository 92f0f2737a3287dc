"""Personal data: patterns with exact checks, and a character-level bidirectional LSTM with CRF transitions.

The patterns' spans are certain. The network is trained in numpy on windows around such spans in a bounded
sample; it reads every whole text in overlapping windows, whose best tag paths are reconciled to one tag a
character. What it finds beyond the patterns is added if it passes the kind's check and touches no span.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import arrow_column, shared

KINDS = ("email", "ip", "card", "phone")
HIDDEN = 8
# Characters of a window, and those at either end whose tags a neighbouring window decides.
WINDOW, MARGIN = 160, 16
# Windows read in lockstep, and how many such sets of texts are laid out together.
LANES, GROUP = 1024, 8
# The network is fitted on windows of about so many documents, chosen by a hash, and on so many a kind.
FIT_DOCS, FIT_WINDOWS, FIT_LENGTH = 6000, 300, 80
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.02, 13

# The patterns and bounds of the four kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole: a start inside one would meet the same next character.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def is_ip(text: str) -> bool:
    return all(map(_octet, text.split(".")))


def is_card(text: str) -> bool:
    number = digits(text)
    return 13 <= len(number) <= 19 and luhn(number)


def is_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs so that long words cost nothing."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            end = match.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; a match that fails its kind's check is dropped."""
    out = [(0, a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, check in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)):
            out.extend((kind, *m.span()) for m in pattern.finditer(text) if check(m[0]))
    return out


def _plausible(kind: int, text: str) -> bool:
    """What an added span of a kind has to be."""
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]+", text) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text) is not None and is_ip(text)
    if kind == 2:
        return re.fullmatch(r"[0-9](?:[\x20-]?[0-9])+", text) is not None and is_card(text)
    return re.fullmatch(r"[+(]?[0-9][\x20()./0-9-]+[0-9]", text) is not None and is_phone(text) and len(re.findall(r"[\x20()./-]+", text)) >= 2


def _classes() -> np.ndarray:
    """Character classes of the first 128 code points; all others are the last class."""
    table = np.full(129, 1, np.int64)
    for k, group in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"@.-+() ,:/_%\n\"'")):
        for c in group:
            table[ord(c)] = k + 2
    table[128] = table.max() + 1
    return table


CLASSES = _classes()
# 0 fills windows beyond the text.
N_CLASSES, N_TAGS = int(CLASSES.max()) + 1, len(KINDS) + 1


def encode(text: str) -> np.ndarray:
    return CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)].astype(np.uint8)


def _squash(gates: np.ndarray) -> None:
    """In place: all rows to [-1, 1], the first three quarters on to [0, 1]; piecewise linear, as it is the hot path."""
    np.clip(gates, -1, 1, out=gates)
    part = gates[: 3 * HIDDEN]
    part *= np.float32(0.5)
    part += np.float32(0.5)


class Network:
    """Arrays are (units, windows); gate rows are input, forget, output, candidate."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def first(cls) -> Network:
        rng = np.random.default_rng(SEED)
        p = {}
        for way in "fb":
            p[f"x{way}"] = rng.normal(0, 0.3, (4 * HIDDEN, N_CLASSES)).astype(np.float32)
            p[f"h{way}"] = rng.normal(0, 0.3, (4 * HIDDEN, HIDDEN)).astype(np.float32)
            p[f"x{way}"][HIDDEN : 2 * HIDDEN] += 0.5
        p["out"] = rng.normal(0, 0.3, (N_TAGS, 2 * HIDDEN)).astype(np.float32)
        p["bias"] = np.zeros((N_TAGS, 1), np.float32)
        p["step"] = np.zeros((N_TAGS, N_TAGS), np.float32)
        return cls(p)

    def _read(self, codes: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, units, windows) of one direction over codes (time, windows)."""
        x, h = self.p[f"x{way}"], self.p[f"h{way}"]
        steps, lanes = codes.shape
        out = np.empty((steps, HIDDEN, lanes), x.dtype)
        hidden, cell = np.zeros((HIDDEN, lanes), x.dtype), np.zeros((HIDDEN, lanes), x.dtype)
        buffer, added = np.empty((4 * HIDDEN, lanes), x.dtype), np.empty((4 * HIDDEN, lanes), x.dtype)
        fresh = np.empty((HIDDEN, lanes), x.dtype)
        order = range(steps) if way == "f" else range(steps - 1, -1, -1)
        for t in order:
            # Into rows of lanes: plain indexing would lay the result out by columns.
            gates = np.take(x, codes[t], axis=1, out=buffer if keep is None else None, mode="clip")
            gates += np.matmul(h, hidden, out=added)
            _squash(gates)
            before = cell if keep is None else cell.copy()
            cell *= gates[HIDDEN : 2 * HIDDEN]
            cell += np.multiply(gates[:HIDDEN], gates[3 * HIDDEN :], out=fresh)
            squashed = np.clip(cell, -1, 1, out=fresh)
            hidden = np.multiply(gates[2 * HIDDEN : 3 * HIDDEN], squashed, out=out[t])
            if keep is not None:
                keep.append((t, gates, before, squashed.copy()))
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        out = self.p["out"]
        scores = np.matmul(out[:, :HIDDEN], self._read(codes, "f"))
        scores += np.matmul(out[:, HIDDEN:], self._read(codes, "b"))
        return np.add(scores, self.p["bias"], out=scores)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Tags (time, windows) of the best path of each window.

        Where no tag comes within twice the largest gain of any transition of a character being plain, the
        plain path is the best one; only the other windows are searched.
        """
        scores, step = self.emissions(codes), self.p["step"]
        gain = 2 * max(0.0, float((step - step[0, 0]).max()))
        rival = scores[:, 1].copy()
        for k in range(2, N_TAGS):
            np.maximum(rival, scores[:, k], out=rival)
        open_windows = np.flatnonzero((scores[:, 0] - rival).min(0) <= gain)
        tags = np.zeros(codes.shape, np.int8)
        if len(open_windows):
            tags[:, open_windows] = self._best_path(scores[:, :, open_windows])
        return tags

    def _best_path(self, scores: np.ndarray) -> np.ndarray:
        step = self.p["step"]
        steps, _, lanes = scores.shape
        back = np.empty((steps, N_TAGS, lanes), np.int8)
        best = scores[0]
        for t in range(1, steps):
            ways = best[:, None] + step[:, :, None]
            back[t] = ways.argmax(0)
            best = ways.max(0) + scores[t]
        tags = np.empty((steps, lanes), np.int8)
        tags[-1] = best.argmax(0)
        every = np.arange(lanes)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t, tags[t], every]
        return tags

    def _crf(self, scores: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log likelihood, and its gradients by emissions and transitions."""
        step = self.p["step"]
        steps, _, lanes = scores.shape
        every = np.arange(lanes)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, steps):
            alpha[t] = _logsum(alpha[t - 1][:, None, :] + step[:, :, None], 0) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsum(step[:, :, None] + (scores[t + 1] + beta[t + 1])[None, :, :], 1)
        whole = _logsum(alpha[-1], 0)
        by_score = np.exp(alpha + beta - whole)
        by_step, path = np.zeros_like(step), scores[0][tags[0], every].copy()
        for t in range(1, steps):
            pair = alpha[t - 1][:, None, :] + step[:, :, None] + (scores[t] + beta[t])[None, :, :] - whole
            by_step += np.exp(pair).sum(2)
            np.subtract.at(by_step, (tags[t - 1], tags[t]), 1)
            path += scores[t][tags[t], every] + step[tags[t - 1], tags[t]]
        for t in range(steps):
            by_score[t][tags[t], every] -= 1
        return float((whole - path).mean()), by_score / lanes, by_step / lanes

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = {way: self._read(codes, way, kept[way]) for way in "fb"}
        both = np.concatenate([states["f"], states["b"]], 1)
        scores = np.matmul(self.p["out"], both) + self.p["bias"]
        loss, by_score, by_step = self._crf(scores, tags)
        grads = {"step": by_step, "bias": by_score.sum((0, 2))[:, None], "out": np.einsum("tkn,tun->ku", by_score, both)}
        by_state = np.matmul(self.p["out"].T, by_score)
        for way, part in (("f", by_state[:, :HIDDEN]), ("b", by_state[:, HIDDEN:])):
            h = self.p[f"h{way}"]
            gx, gh = np.zeros_like(self.p[f"x{way}"]), np.zeros_like(h)
            to_hidden = np.zeros((HIDDEN, codes.shape[1]), np.float32)
            to_cell = np.zeros_like(to_hidden)
            for t, gates, before, squashed in reversed(kept[way]):
                i, f, o, g = (gates[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
                down = part[t] + to_hidden
                to_cell = to_cell + down * o * (np.abs(squashed) < 1)
                raw = np.concatenate([to_cell * g * _slope(i), to_cell * before * _slope(f), down * squashed * _slope(o), to_cell * i * (np.abs(g) < 1)])
                to_cell = to_cell * f
                to_hidden = h.T @ raw
                earlier = t - 1 if way == "f" else t + 1
                if 0 <= earlier < len(codes):
                    gh += raw @ states[way][earlier].T
                np.add.at(gx.T, codes[t], raw.T)
            grads[f"x{way}"], grads[f"h{way}"] = gx, gh
        return loss, grads


def _slope(gate: np.ndarray) -> np.ndarray:
    return 0.5 * ((gate > 0) & (gate < 1))


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis)) + top.squeeze(axis)


def training_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, tags), each (windows, FIT_LENGTH): windows that hold a pattern's span at any place, and as many without.

    Windows with a match that failed its check are left out: characters alone do not tell them apart.
    """
    rng = np.random.default_rng(SEED)
    found: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in range(N_TAGS)}
    spans = [base_spans(text) for text in texts]
    for row, text in enumerate(texts):
        for kind, a, b in spans[row]:
            found[kind + 1].append((row, kind, a, b))
        if len(text) > FIT_LENGTH:
            found[0].append((row, -1, int(rng.integers(len(text))), 0))
    codes, tags = [], []
    for group in range(N_TAGS):
        chosen = found[group]
        if len(chosen) > FIT_WINDOWS:
            chosen = [chosen[k] for k in rng.permutation(len(chosen))[:FIT_WINDOWS]]
        for row, kind, a, b in chosen:
            text = texts[row]
            low = max(0, min(a, len(text) - 1) - int(rng.integers(FIT_LENGTH // 4, FIT_LENGTH * 3 // 4)))
            part = text[low : low + FIT_LENGTH]
            tag = np.zeros(FIT_LENGTH, np.int64)
            for other, s, e in spans[row]:
                tag[max(0, s - low) : max(0, e - low)] = other + 1
            loose = np.zeros(FIT_LENGTH, bool)
            for m in re.finditer(r"[0-9][0-9\x20().-]{7,}[0-9]", part):
                loose[m.start() : m.end()] = True
            if (loose & (tag == 0)).sum() > 4:
                continue
            code = np.zeros(FIT_LENGTH, np.uint8)
            code[: len(part)] = encode(part)
            codes.append(code)
            tags.append(tag)
    return np.array(codes, np.uint8).reshape(-1, FIT_LENGTH), np.array(tags, np.int64).reshape(-1, FIT_LENGTH)


def train(codes: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters after EPOCHS of Adam steps on the CRF's likelihood, with clipped gradients."""
    network, rng = Network.first(), np.random.default_rng(SEED)
    m = {k: np.zeros_like(v) for k, v in network.p.items()}
    v = {k: np.zeros_like(x) for k, x in network.p.items()}
    step, total = 0, EPOCHS * -(-len(codes) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(codes))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            _, grads = network.gradients(codes[some].T, tags[some].T)
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for name, grad in grads.items():
                grad = np.clip(grad, -5, 5)
                m[name] += 0.1 * (grad - m[name])
                v[name] += 0.01 * (grad**2 - v[name])
                change = rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
                network.p[name] -= change.astype(np.float32)
    return network.p


class Tagger:
    def __init__(self, parameters: dict[str, np.ndarray]):
        self.network = Network(parameters)

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """One tag for each character of each text.

        Windows advance by their length less two margins. Each decides the characters in its middle; the
        first and last ones of a text also decide their outer margin.
        """
        stride = WINDOW - 2 * MARGIN
        sizes = np.array([len(t) for t in texts])
        counts = np.maximum(1, -(-(sizes - 2 * MARGIN) // stride))
        padded = counts * stride + 2 * MARGIN
        firsts = np.concatenate([[0], np.cumsum(padded)])
        codes, tags = np.zeros(firsts[-1], np.uint8), np.zeros(firsts[-1], np.int8)
        for text, first in zip(texts, firsts):
            codes[first : first + len(text)] = encode(text)
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = firsts[owner] + number * stride
        last = number == counts[owner] - 1
        for k in range(0, len(starts), LANES):
            some = slice(k, k + LANES)
            read = self.network.decode(codes[starts[some, None] + np.arange(WINDOW)].T.copy()).T
            tags[starts[some, None] + np.arange(MARGIN, WINDOW - MARGIN)] = read[:, MARGIN : WINDOW - MARGIN]
            edge = number[some] == 0
            tags[starts[some][edge][:, None] + np.arange(MARGIN)] = read[edge, :MARGIN]
            edge = last[some]
            tags[starts[some][edge][:, None] + np.arange(WINDOW - MARGIN, WINDOW)] = read[edge, WINDOW - MARGIN :]
        return [tags[first : first + size] for first, size in zip(firsts, sizes)]

    def added(self, text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Tagged spans that pass their kind's check and touch no certain span."""
        if not tags.any():
            return []
        edges = np.flatnonzero(np.diff(tags, prepend=0, append=0))
        out = []
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            kind = int(tags[start]) - 1
            if kind < 0:
                continue
            while start < end and text[start].isspace():
                start += 1
            while start < end and text[end - 1].isspace():
                end -= 1
            if all(end <= a or b <= start for _, a, b in base) and _plausible(kind, text[start:end]):
                out.append((kind, start, end))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """A tagger trained in one task on a bounded sample; None where the sample holds no span."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    total = texts.count()
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    sample = texts.where(place < min(1.0, FIT_DOCS / max(total, 1)))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        codes, tags = training_windows(rows.sort_values(["id", "text"])["text"].tolist())
        out = io.BytesIO()
        if tags.any():
            np.savez(out, **train(codes, tags))
        return pd.DataFrame({"model": [out.getvalue()]})

    # Only texts with a sign or digit can hold a span; a fixed share of the others serves as counterexamples.
    useful = F.col("text").rlike("[@0-9]") | (F.pmod(F.xxhash64("text"), F.lit(10)) == 0)
    learned = sample.where(useful).select("id", "text", F.lit(0).alias("all")).groupBy("all").applyInPandas(learn, "model binary").collect()
    if not learned or not learned[0]["model"]:
        return None
    return Tagger(dict(np.load(io.BytesIO(bytes(learned[0]["model"])))))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def spans_column(spark: SparkSession, tagger: Tagger | None, text_col: str = "text") -> Column:
    """Struct of the patterns' counts by kind, the patterns' spans, and all spans, as kind:start:end lists.

    Offsets are code points, ends exclusive; lists go by kind, then start. Null texts count as empty: counts
    0, lists empty. Without a tagger only the patterns apply. Rows are judged one by one.
    """
    held = shared(spark, tagger)

    def find(column: pa.Array) -> pa.Array:
        model, texts = held(), [text or "" for text in column.to_pylist()]
        rows, first = [], 0
        while first < len(texts):
            size, end = 0, first
            while end < len(texts) and (end == first or size + len(texts[end]) < GROUP * LANES * WINDOW):
                size += len(texts[end])
                end += 1
            part = texts[first:end]
            tags = model.tags(part) if model else [np.zeros(0, np.int8)] * len(part)
            for text, tag in zip(part, tags):
                base = base_spans(text)
                rows.append((base, sorted(base + model.added(text, tag, base)) if model else base))
            first = end
        counts = [pa.array([sum(kind == k for kind, _, _ in base) for base, _ in rows], pa.int64()) for k in range(len(KINDS))]
        lists = [pa.array([",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in row[j]) for row in rows], pa.string()) for j in range(2)]
        return pa.StructArray.from_arrays([*counts, *lists], ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return arrow_column(find, FOUND, text_col)
