import random

import pytest

from chromaloom.llm import simhash
from chromaloom.llm.components import connected_components
from chromaloom.session import materialise
from tests.llm.helpers import documents


def components(fps):
    """Component of each place by comparing all pairs."""
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(fps))]


@pytest.mark.parametrize("bucket_rows", [256, 3])
def test_links_equal_all_pairs(spark, bucket_rows):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    fps = set(centres)
    for centre in centres:
        for _ in range(25):
            value = centre
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                value ^= 1 << bit
            fps.add(value)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {frozenset(r) for r in simhash.links(frame, bucket_rows).collect()}
    near = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == near and len(near) > 50


@pytest.mark.parametrize("bucket_rows", [256, 1])
def test_variants_are_never_broadcast(spark, bucket_rows):
    """A side holds 33 rows (or 2016) for each fingerprint, which its size as Spark takes it does not show."""
    fps = materialise(spark.createDataFrame([(k,) for k in range(8)], "fp long"), "fps")
    plan = simhash.links(fps, bucket_rows)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and ("[key" in line or "[slot" in line)]
    assert len(joins) == (1 if bucket_rows == 256 else 3) and all("SortMergeJoin" in line for line in joins)


def test_documents_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "of", "Ünd", "la", "zur", "an", "it", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    texts += [None, "", " \t\n", "A b C", "a B c", "long " * 20_000, "long " * 20_001]
    got = simhash.near_duplicates(documents(spark, list(enumerate(texts)), fingerprint="x", component_id="y"), bucket_rows=2).collect()
    assert len(got) == len(texts)
    fp = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    named = components([fp[k] for k in range(len(texts))])
    least = {}
    for k, c in enumerate(named):
        least[c] = min(least.get(c, k), k)
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: least[c] for k, c in enumerate(named)}
    assert fp[80] == fp[81] == fp[82] == 0 and fp[83] == fp[84] and all(len(r["fingerprint"]) == 16 for r in got)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q w e r t y"), (7, None)])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 5, 5), (False, 5, 5), (False, 7, 7), (True, 0, 0), (True, 0, 5)]
    kept = simhash.keep_one(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, "q w e r t y"), (5, "a b c d"), (7, "")]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_of_each_group_stays(spark):
    docs = documents(spark, [(3, "a b c d"), (1, "a b c d"), (2, "something else entirely here"), (9, "a b c d")])
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 2]


def test_rows_of_one_id_are_decided_on_one_by_one(spark):
    """No text is lost because another row of its id goes; names used inside meet no column of the table."""
    rows = [(1, "one text of some words"), (2, "one text of some words"), (2, "another text altogether, quite unlike it"), (2, "another text altogether, quite unlike it")]
    rows += [(None, "one text of some words"), (None, "words without any id here"), (None, "words without any id here")]
    docs = documents(spark, rows, _row="clash", fp="clash", first="clash").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"], r["_row"], r["fp"]) for r in kept.collect())
    assert got == [
        (0, "words without any id here", "clash", "clash"),
        (1, "one text of some words", "clash", "clash"),
        (2, "another text altogether, quite unlike it", "clash", "clash"),
    ]
    assert simhash.keep_one(documents(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (3, 2), (None, 4)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}
