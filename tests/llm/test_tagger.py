import random
import re

import numpy as np
import pytest

from chromaloom.llm import queries, tagger
from tests.llm.helpers import SF_DIR, documents, needs_tables, sql

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    number = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
        return 13 <= len(number) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(number) <= 15


def plain(text):
    return [(k, *m.span()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(kind, m[0])]


def test_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    pieces = ["a", "é", "@", ".", "-", "+", " ", "1", "22", "255", "256", "4111 1111 1111 1111", "%", "_", "(", ")", "x.y@z", "1.2.3.4", "\n", "0007"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a@b.c@d.e", "a@b@c.d", "@x.y", "1.2.3.4.5.6.7.8", "+1+1234567890", "a@b..c", "a.@b.c.", "0000255.1.1.1", ""]
    for text in texts:
        assert tagger.base_spans(text) == plain(text)


def test_long_runs_cost_little():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@" * 300_000, "+1 " * 100_000):
        tagger.base_spans(text)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    network = tagger.Network.first()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    codes, tags = rng.integers(0, tagger.N_CLASSES, (7, 4)).astype(np.uint8), rng.integers(0, tagger.N_TAGS, (7, 4))
    _, grads = network.gradients(codes, tags)
    for name, values in network.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in values.shape)
            if name.startswith("x"):
                at = (at[0], int(codes[rng.integers(7), rng.integers(4)]))
            old, losses = values[at], []
            for change in (1e-4, -1e-4):
                values[at] = old + change
                losses.append(network.gradients(codes, tags)[0])
            values[at] = old
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, abs=1e-5)


def test_decoding_equals_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    network = tagger.Network.first()
    network.p["step"] = rng.normal(size=(tagger.N_TAGS,) * 2).astype(np.float32)
    for plain_bonus in (0.0, 1.0, 30.0):
        network.p["bias"][0] = plain_bonus
        codes = rng.integers(0, tagger.N_CLASSES, (5, 6)).astype(np.uint8)
        scores, got = network.emissions(codes), network.decode(codes)
        for lane in range(6):
            value = lambda z: sum(scores[t, k, lane] for t, k in enumerate(z)) + sum(network.p["step"][a, b] for a, b in zip(z, z[1:]))
            best = max(itertools.product(range(tagger.N_TAGS), repeat=5), key=value)
            assert value(tuple(got[:, lane])) == pytest.approx(value(best), abs=1e-4)


def trained():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for _ in range(400):
        spans = [f"{word()}@{word()}.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), f"+1 ({number(3)}) {number(3)}-{number(4)}"]
        texts.append(" ".join([word() for _ in range(20)] + [rng.choice(spans)] + [word() for _ in range(20)]))
    return tagger.Tagger(tagger.train(*tagger.training_windows(texts))), texts


def test_training_finds_the_labelled_spans_anew():
    model, texts = trained()
    right = total = 0
    for text, tags in zip(texts[:60], model.tags(texts[:60])):
        assert len(tags) == len(text)
        for kind, a, b in tagger.base_spans(text):
            right += (tags[a:b] == kind + 1).mean() > 0.8
            total += 1
    assert right >= 0.9 * total > 0


def test_windows_are_reconciled_alike_alone_and_in_company():
    model, texts = trained()
    long = " ".join(texts[:20])
    alone = model.tags([long])[0]
    assert np.array_equal(alone, model.tags(["x", long, "", texts[0]])[1])
    for kind, a, b in tagger.base_spans(long)[:10]:
        assert (alone[a:b] == kind + 1).mean() > 0.6


def test_additions_pass_checks_and_touch_no_pattern_span():
    model, _ = trained()
    text = "abc def (389) 555-5010 gh joséé@ab.com bcd 1.2.3.4 abc"
    base = tagger.base_spans(text)
    tags = np.zeros(len(text), np.int8)
    tags[8:22], tags[26:38], tags[43:50] = 4, 1, 4
    assert model.added(text, tags, base) == [(3, 8, 22), (0, 26, 38)]


def test_nulls_empty_tables_and_clashing_names(spark):
    model, _ = trained()
    docs = documents(spark, [(1, None), (2, ""), (None, "me@ab.com 10.0.0.1"), (3, "é 😀 +1 (389) 555-5010 " + "x " * 20_000)], spans="clash", base="clash")
    got = {r["doc_id"]: r["found"] for r in docs.withColumn("found", tagger.spans_column(spark, model)).collect()}
    assert got[1]["spans"] == got[2]["spans"] == "" and got[1]["n_email"] == 0
    assert got[None]["base"] == "email:0:9,ip:10:18" and got[3]["base"] == "phone:4:21"
    assert set(got[3]["base"].split(",")) <= set(got[3]["spans"].split(","))
    assert documents(spark, []).select(tagger.spans_column(spark, None)).count() == 0
    assert tagger.fit(documents(spark, [(1, "nothing here"), (2, None)])) is None


@needs_tables
def test_query_equals_the_plain_patterns(spark):
    import hashlib

    texts = dict(sql("SELECT doc_id, text FROM documents").fetchall())
    for row in queries.op8_personal_data(spark, SF_DIR).collect():
        base = [f"{list(PATTERNS)[k]}:{a}:{b}" for k, a, b in plain(texts[row["doc_id"]] or "")]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        assert set(base) <= set(row["spans"].split(",")) | {""}
