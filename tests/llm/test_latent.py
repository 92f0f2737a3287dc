import random

import numpy as np
import pytest

from chromaloom.llm import latent, queries
from tests.llm.helpers import SF_DIR, documents, needs_tables, sql


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def test_lcs_equals_the_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 90)).astype(np.uint64) for _ in range(2))
        assert latent.lcs(a, b) == plain_lcs(a.tolist(), b.tolist())


def test_words_do_not_depend_on_neighbours_or_chunks(monkeypatch):
    texts = ["The cat, the CAT!", None, "", "über-Straße 42", "x" * 500 + " " + "word " * 300, "cat"]
    one = [list(latent.Words().of([t])) for t in texts]
    together = list(latent.Words().of(texts))
    assert all(np.array_equal(a[0], b) for a, b in zip(one, together))
    the, cat, the2, cat2 = together[0]
    assert the == the2 and cat == cat2 == together[5][0] != the
    assert [len(t) for t in together] == [4, 0, 0, 3, 301, 1]
    monkeypatch.setattr(latent, "CHUNK", 64)
    cut = latent.Words()
    assert np.array_equal(next(cut.of(["word " * 100])), next(latent.Words().of(["word " * 100])))


def test_basis_spans_the_passages(spark):
    """With fewer passages than directions nothing is lost: every passage lies in the latent space."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(24)) for _ in range(12)]
    items = spark.createDataFrame([(t,) for t in texts], "text string")
    idf = np.ones(latent.FEATURES)
    basis = latent.latent_basis(items, idf)
    for hashed in latent.Words().of(texts):
        for _, used, weight in latent._vectors(hashed, idf, latent.ITEM_STEP):
            assert np.linalg.norm(weight @ basis.at(used)) == pytest.approx(1, abs=1e-3)
    gram = basis.values.T @ basis.values
    strong = np.diag(gram) > 0.5
    assert np.allclose(gram[np.ix_(strong, strong)], np.eye(strong.sum()), atol=1e-3)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(8, 60)) + ". " + say(5) + ".") for k in range(30)]
    return rng, vocabulary, say, items


def test_exact_and_paraphrased_items_are_found_and_clean_texts_left(spark):
    rng, vocabulary, say, items = corpus()
    docs, want = [], set()
    for k in range(60):
        docs.append((k, say(rng.randint(0, 300))))
    for k, (item, text) in enumerate(items):
        docs.append((100 + k, f"{say(70)} {text} {say(90)}"))
        want.add((100 + k, item))
        changed = " ".join(rng.choice(vocabulary) if j % 6 == 5 else w for j, w in enumerate(text.split()))
        docs.append((200 + k, f"{say(33)} {changed.upper()}, {say(41)}"))
        want.add((200 + k, item))
    frame = documents(spark, docs, item_id="clash")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    indexes = latent.fit(frame, benchmark)
    leaks = frame.select("doc_id", latent.F.explode(latent.leak_column(spark, indexes)).alias("l")).select("doc_id", "l.*").collect()
    got = {(r["doc_id"], r["item_id"]) for r in leaks}
    assert {p for p in got if p[0] < 200} == {p for p in want if p[0] < 200}
    assert got <= want and len(got) >= 0.9 * len(want)
    clean = {r["doc_id"] for r in latent.without_leaks(frame, indexes).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    rng, _, say, items = corpus(2)
    docs = documents(spark, [(k, f"{say(20)} {text} {say(20)}") for k, text in items])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(latent, "BLOCK_ITEMS", 8)
    indexes = latent.fit(docs, benchmark)
    assert len(indexes) == 4
    found = docs.select("doc_id", latent.F.explode(latent.leak_column(spark, indexes)).alias("l")).select("doc_id", "l.item_id").collect()
    assert {tuple(r) for r in found} == {(k, k) for k, _ in items}


def test_nulls_short_items_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, text), (2, None), (None, text), (3, "too short"), (4, ""), (1, text)], "item_id long, text string")
    docs = documents(spark, [(1, None), (2, ""), (None, "zero " + text), (3, "too short"), (4, text.split(" ", 1)[1] * 3000)])
    indexes = latent.fit(docs, benchmark)
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in docs.withColumn("leaks", latent.leak_column(spark, indexes)).collect()}
    assert got == {1: [], 2: [], None: [1, 1], 3: [], 4: [1, 1]}
    none = latent.fit(docs, benchmark.where("false"))
    assert latent.without_leaks(docs, none).count() == 5
    assert latent.without_leaks(documents(spark, []), latent.fit(documents(spark, []), benchmark)).count() == 0


@needs_tables
def test_query_equals_exact_runs_of_words(spark):
    """Every item that stands whole in a text, by plain search, and no text that shares few runs of words."""
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_benchmark_leaks(spark, SF_DIR).collect()}
    items = sql("SELECT item_id, text FROM benchmark").fetchall()
    whole, touched = set(), set()
    for doc, text in sql("SELECT doc_id, text FROM documents").fetchall():
        words = (text or "").split()
        runs = {tuple(words[j : j + 5]) for j in range(len(words))}
        for item, own in items:
            own_words = own.split()
            if own in (text or ""):
                whole.add((doc, item))
            if any(tuple(own_words[j : j + 5]) in runs for j in range(len(own_words) - 4)):
                touched.add((doc, item))
    assert whole <= got <= touched and whole


def found_in(spark, docs, items):
    frame, benchmark = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    column = latent.leak_column(spark, latent.fit(frame, benchmark))
    leaks = frame.select("doc_id", latent.F.explode(column).alias("l")).select("doc_id", "l.item_id").collect()
    return {tuple(r) for r in leaks}


def rare(rng, n):
    return " ".join("".join(rng.choice("bcdfghjkmpqvwxyz") for _ in range(12)) for _ in range(n))


def test_whole_short_items_are_found_between_rare_words(spark):
    rng = random.Random(4)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(120)]
    items = [(k, " ".join(rng.sample(common, 5 + k % 11))) for k in range(66)]
    plain = [(k, " ".join(rng.sample(common, 40))) for k in range(40)]
    docs = [(100 + k, f"{rare(rng, 17 + k)} {text} {rare(rng, 30 - k % 9)}") for k, text in items]
    got = found_in(spark, plain + docs, items)
    assert {(100 + k, k) for k, _ in items} <= got


def test_paraphrases_with_rare_words_are_found(spark):
    """Twelve of sixteen words kept in order: under half of the squared weight, a cosine of over a half."""
    rng = random.Random(5)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(120)]
    items = [(k, " ".join(rng.sample(common, 16))) for k in range(8)]
    plain = [(k, " ".join(rng.sample(common, 40))) for k in range(90)]
    docs = []
    for k, text in items:
        words = text.split()
        for j in (2, 6, 9, 13):
            words[j] = rare(rng, 1)
        docs.append((100 + k, f"{rare(rng, 16)} {' '.join(words)} {rare(rng, 16)}"))
    assert {(100 + k, k) for k, _ in items} <= found_in(spark, plain + docs, items)


def test_items_of_unspaced_scripts_are_found_inside_longer_text(spark):
    rng = random.Random(6)
    say = lambda first, last, n: "".join(chr(rng.randint(first, last)) for _ in range(n))
    scripts = [(0x4E00, 0x9FA0), (0x3041, 0x3090), (0x0E01, 0x0E2E)]
    items = [(10 * j + k, say(*script, 6 + 7 * k)) for j, script in enumerate(scripts) for k in range(6)]
    docs = [(100 + item, say(*scripts[item // 10], 40) + text + say(*scripts[item // 10], 23)) for item, text in items]
    clean = [(j, say(*script, 200)) for j, script in enumerate(scripts)]
    assert found_in(spark, docs + clean, items) == {(100 + item, item) for item, _ in items}


def test_words_of_unspaced_scripts_are_pairs_of_characters():
    count = lambda text: len(next(latent.Words().of([text])))
    assert [count(t) for t in ("数据集很大", "数据，很大。", "用Python写", "ＡＢ", "Ελλάδα über", "한국어 문장")] == [4, 2, 3, 1, 2, 2]
    assert latent.last_sentence("问题是什么？答案很长。") == "答案很长"


def marked(seed):
    rng, _, say, items = corpus(seed)
    texts = [say(rng.randint(0, 300)) for _ in range(20)]
    texts += [f"{say(70)} {text} {say(9)} {text[: len(text) // 2]} {say(30)}" for _, text in items] + ["", items[0][1] * 40]
    hashed = list(latent.Words().of(texts))
    idf = np.ones(latent.FEATURES)
    index = latent.Index([(k, text, None) for k, text in items], idf, latent.Rows(np.zeros(0, np.int64), np.zeros((0, latent.RANK))))
    feature = (np.concatenate(hashed) & np.uint64(latent.FEATURES - 1)).astype(np.int64)
    row = index.row[feature]
    return rng, hashed, index, feature, np.where(row < 0, len(index.basis) - 1, row)


def test_marks_lose_no_word_of_an_item(monkeypatch):
    monkeypatch.setattr(latent, "CHUNK", 200)
    rng, hashed, index, feature, row = marked(7)
    before = latent._before(feature)
    assert before.tolist() == [max((j for j in range(k) if feature[j] == f), default=-1) for k, f in enumerate(feature[:400])] + before[400:].tolist()
    words = np.concatenate(hashed)
    parts = [(begin, rng.randint(0, 120), item) for begin in range(0, len(words) - 130, 37) for item in range(len(index.ids))]
    starts, lengths, items = (np.array(x) for x in zip(*parts))
    hits = index._hits(row, before, starts, lengths, items)
    there = [len(index.sets[k].intersection(words[b : b + n].tolist())) for b, n, k in parts]
    # No fewer, and beyond words that share a feature hardly more.
    own = np.array([len(index.sets[k]) for k in items])
    assert (hits + index.repeats[items] >= np.array(there) + index.lengths[items] - own).all()
    assert hits.sum() <= 1.2 * sum(there)


def test_sizes_count_repeats_within_the_window():
    rng = np.random.default_rng(8)
    feature = rng.integers(0, latent.FEATURES, 60)[rng.integers(0, 60, 3000)]
    squares = rng.random(latent.FEATURES)[feature]
    starts = rng.integers(0, 2990, 2000)
    ends = np.minimum(starts + rng.integers(1, 17, 2000), 3000)
    got = latent._sizes(feature, latent._before(feature), squares, starts, ends, 16)
    for size, a, b in zip(got, starts, ends):
        used, at, times = np.unique(feature[a:b], return_index=True, return_counts=True)
        assert size == pytest.approx((squares[a:b][at] * times**2).sum())


def test_few_parts_are_read_word_by_word(monkeypatch):
    """Parts that share too few words with the item go by their marks; only the others are compared as sets."""
    rng, hashed, index, feature, row = marked(9)
    read = []

    class Watched(frozenset):
        def intersection(self, other):
            read.append(1)
            return frozenset.intersection(self, other)

    index.sets = [Watched(own) for own in index.sets]
    near = [(k, item) for k in range(len(hashed)) for item in range(len(index.ids)) if len(hashed[k])]
    text, item = (np.array(x) for x in zip(*near))
    runs = np.arange(len(near)), np.full(len(near), 75), np.full(len(near), 75)
    monkeypatch.setattr(latent.Index, "candidates", lambda self, *given: (text, item, np.ones(len(near)), *runs))
    index.latent = np.ones((1, latent.RANK), np.float32)
    found = index.leaks(hashed)
    assert sum(map(len, found)) >= len(index.ids) and len(read) <= len(near) / 4


def test_texts_below_the_unspaced_scripts_are_left_as_they_are():
    for text in ("über façade", "Ελλάδα где", "a—b “c”", "\ud800x", "数据x", "", "෿a"):
        assert latent._spaced(text) == latent._UNSPACED.sub(latent._pairs, latent._MARKS.sub(" ", text))
