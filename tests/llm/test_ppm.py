import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from chromaloom.llm import ppm, queries
from tests.llm.helpers import SF_DIR, documents, fold, needs_tables, sql

ENGLISH, GERMAN = ["the thing that they were then", "this and that other thing"] * 4, ["der die das und ein schöner Tag", "nicht ich sondern die Strasse"] * 4


def trees(**texts):
    return ppm.Trees({k: ppm._grams(v, ppm.ORDER) for k, v in texts.items()}, ppm.ORDER)


def plain_bits(training, text):
    """Code length by walking the contexts of every byte, excluding what longer ones offered."""
    contexts = defaultdict(Counter)
    pad = bytes([ppm.PAD]) * ppm.ORDER
    for one in training:
        data = pad + one.lower().encode()
        for i in range(ppm.ORDER, len(data)):
            for m in range(ppm.ORDER + 1):
                contexts[data[i - m : i]][data[i]] += 1
    data, bits = pad + text.lower().encode(), 0.0
    for i in range(ppm.ORDER, len(data)):
        offered = set()
        for m in range(ppm.ORDER, -1, -1):
            seen = contexts.get(data[i - m : i])
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in offered}
            n, d = sum(left.values()), len(left)
            if data[i] in left:
                bits += math.log2((n + d) / left[data[i]])
                break
            bits += math.log2((n + d) / d) if d else 0
            offered |= set(seen)
        else:
            bits += math.log2(256 - len(offered))
    return bits


@pytest.mark.parametrize("text", ["the thing", "schöner", "Привет, world", "zzz\x00\x7f", "t", "a" * 300])
def test_lengths_equal_a_plain_walk(text):
    model = trees(en=ENGLISH, de=GERMAN)
    got = model.score([text])[0]
    want = [plain_bits({"en": ENGLISH, "de": GERMAN}[k], text) for k in model.languages]
    assert got == pytest.approx(want, rel=1e-5)


def test_chunks_and_neighbours_do_not_matter(monkeypatch):
    model = trees(en=ENGLISH, de=GERMAN)
    texts = ["the und " * 700, "x", "das " * 10]
    whole = model.score(texts)
    monkeypatch.setattr(ppm, "CHUNK", 64)
    assert np.allclose(model.score(texts), whole, rtol=1e-5)
    assert np.allclose(model.score(texts[::-1])[::-1], whole, rtol=1e-5)


def test_the_code_is_proper():
    """Over all 256 next bytes the probabilities sum to one."""
    model = trees(en=ENGLISH)
    before = np.frombuffer(b"that t", np.uint8)
    sums = 0.0
    for byte in range(256):
        sums += 2.0 ** -model.lengths(np.append(before, np.uint8(byte)))[-1, 0]
    assert sums == pytest.approx(1.0, rel=1e-5)


def test_undetermined_nulls_and_clashing_names(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, " 12 3!\n"), (4, "the thing that"), (None, "der die das"), (4, "the thing that")], score="x", lang="y")
    got = ppm.identify(docs, trees(en=ENGLISH, de=GERMAN)).collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == 0 and got[3]["score"] > 0.9
    assert {r["lang"] for r in got} == {"y"}
    assert ppm.in_known_language(docs, trees(en=ENGLISH, de=GERMAN)).count() == 3
    assert ppm.identify(documents(spark, []), trees(en=ENGLISH)).count() == 0


def test_nothing_learned_means_undetermined(spark):
    docs = documents(spark, [(1, "words here")]).selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert ppm.fit(docs) is None
    assert ppm.identify(docs, None).first()["lang_pred"] == "und"


def test_noise_is_in_no_language(spark):
    rng = np.random.default_rng(0)
    noise = "a" + "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9FFF, 200))
    assert ppm.in_known_language(documents(spark, [(1, noise), (2, "the thing")]), trees(en=ENGLISH)).first()["doc_id"] == 2


@needs_tables
def test_query_on_held_out_documents(spark):
    got = queries.op2_language_id(spark, SF_DIR).toPandas().merge(sql("SELECT doc_id, lang FROM documents").df(), on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda k: fold(k, 5) == 0)).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
