import glob
import itertools
import math
import os
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chromaloom.llm import hmm, queries
from tests.llm.helpers import SF_DIR, documents, fold, needs_tables, sql


def small():
    return hmm.Chain.first(np.arange(1, 8.0), 3)


def paths(chain, seen):
    for z in itertools.product(range(3), repeat=len(seen)):
        p = chain.start[z[0]] * chain.emit[seen[0], z[0]]
        for k in range(1, len(seen)):
            p *= chain.step[z[k - 1], z[k]] * chain.emit[seen[k], z[k]]
        yield z, p


SEEN = [np.array(s, np.int32) for s in ([3], [1, 2, 2, 6], [0, 5], [6, 6, 1, 0, 4], [2, 3])]


def test_likelihood_equals_the_sum_over_paths():
    got = small().log10_likelihood(SEEN)
    assert got == pytest.approx([math.log10(sum(p for _, p in paths(small(), s))) for s in SEEN])


def test_expected_counts_equal_the_sum_over_paths():
    chain, sums = small(), (np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3)))
    chain.expectations(SEEN, sums)
    start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    for s in SEEN:
        total = sum(p for _, p in paths(chain, s))
        for z, p in paths(chain, s):
            start[z[0]] += p / total
            for k, state in enumerate(z):
                emit[s[k], state] += p / total
                if k:
                    step[z[k - 1], state] += p / total
    assert np.allclose(sums[0], start) and np.allclose(sums[1], step) and np.allclose(sums[2], emit)


def test_rounds_raise_the_likelihood(spark, monkeypatch):
    texts = ["a b a b c", "c c d", "a b", None, "d c d c"] * 5
    docs = documents(spark, list(enumerate(texts)))
    scores = []
    for rounds in (0, 1, 4):
        monkeypatch.setattr(hmm, "WARM_ROUNDS", 0)
        monkeypatch.setattr(hmm, "FULL_ROUNDS", rounds)
        scores.append(sum(r["score"] for r in hmm.score(docs, hmm.fit(docs)).collect()))
    assert scores[0] < scores[1] < scores[2]


@pytest.mark.parametrize("symbols,known", [(4096, 200_000), (3, 200_000), (3, 5), (2, 2)])
def test_scores_do_not_depend_on_where_counts_live(spark, monkeypatch, symbols, known):
    """Base and chain scores by plain sums, however many words the tasks know."""
    monkeypatch.setattr(hmm, "SYMBOLS", symbols)
    monkeypatch.setattr(hmm, "KNOWN_WORDS", known)
    texts = ["The cat the CAT sat", "a cat Ä ä", "", None, "dog " * 40, "unseen words the", "the\tcat\x0bsat\nnow"]
    docs = documents(spark, list(enumerate(texts)), base_score="x")
    model = hmm.fit(docs.where("doc_id <> 5"))
    got = {r["doc_id"]: r for r in hmm.score(docs, model).collect()}
    counts = Counter()
    for k, text in enumerate(texts):
        if k != 5:
            counts.update(hmm.tokens((text or "").encode()))
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    own = model.vocabulary
    place = {w.encode(): k for k, w in enumerate(own.words[: own.symbols])}
    for k, text in enumerate(texts):
        words = hmm.tokens((text or "").encode())
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*words, "end"])
        assert got[k]["base_score"] == pytest.approx(base)
        assert got[k]["n_tokens"] == len(words) + 1 and got[k]["train_tokens"] == n
        assert got[k]["n_known"] == 1 + sum(w in counts for w in words)
        seen = np.array([place.get(w, own.other) for w in words] + [own.end], np.int32)
        hidden = sum(math.log10((counts.get(w, 0) + 1) / (own.other_total + own.other_distinct + 1)) for w in words if w not in place)
        assert got[k]["score"] == pytest.approx(model.chain.log10_likelihood([seen])[0] + hidden)


def test_empty_tables_repeats_and_null_ids(spark):
    docs = documents(spark, [(None, "a b"), (None, "a b"), (1, "a")])
    model = hmm.fit(docs)
    got = [r["score"] for r in hmm.score(docs, model).orderBy("doc_id").collect()]
    assert len(got) == 3 and got[0] == got[1]
    assert hmm.score(documents(spark, []), model).count() == 0
    empty = hmm.fit(documents(spark, []))
    assert hmm.score(docs, empty).where("n_known = 0 AND train_tokens = 0").count() == 3


@needs_tables
def test_query(spark):
    got = queries.op6_hidden_markov(spark, SF_DIR).toPandas().set_index("doc_id")
    texts = dict(sql("SELECT doc_id, text FROM documents").fetchall())
    counts = Counter()
    for k, text in texts.items():
        if fold(k, 7) != 2:
            counts.update([*hmm.tokens((text or "").encode()), "end"])
    n, v = sum(counts.values()), len(counts)
    for k, text in texts.items():
        want = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*hmm.tokens((text or "").encode()), "end"])
        assert got.loc[k, "base_score"] == pytest.approx(want) and got.loc[k, "held_out"] == (fold(k, 7) == 2)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_every_round_sees_every_document(spark, monkeypatch):
    """The chain of a table of many documents is that of plain rounds over all of them."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e"], rng.integers(1, 5))) for _ in range(5000)]
    monkeypatch.setattr(hmm, "WARM_ROUNDS", 2)
    model = hmm.fit(documents(spark, list(enumerate(texts))).repartition(3), states=3)
    own = model.vocabulary
    counts = own.symbol_counts()
    chain = hmm.Chain.first(own.symbol_counts(), 3)
    seen = [own.reader()(text.encode())[0] for text in texts]
    for _ in range(3):
        sums = np.zeros(3), np.zeros((3, 3)), np.zeros((len(counts), 3))
        chain.expectations(seen, sums)
        share = sums[2].sum(0) + hmm.PRIOR
        start, step, emit = sums[0] + hmm.PRIOR, sums[1] + hmm.PRIOR, sums[2] + share / share.sum()
        chain = hmm.Chain(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    assert np.allclose(model.chain.start, chain.start) and np.allclose(model.chain.step, chain.step)
    assert np.allclose(model.chain.emit, chain.emit)


def test_all_known_words_have_emissions_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(hmm, "WARM_ROUNDS", 0)
    model = hmm.fit(documents(spark, [(0, " ".join(f"w{k}" for k in range(6000)))]))
    assert model.vocabulary.symbols == 6000 and model.chain.emit.shape == (6002, hmm.STATES)


def test_one_state_is_the_add_one_model(spark, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 3)
    docs = documents(spark, [(0, "a a a b b c d e"), (1, "c c b unseen f")])
    got = hmm.score(docs, hmm.fit(docs.where("doc_id = 0"), states=1)).collect()
    steps = {r["doc_id"]: r["score"] - r["base_score"] for r in got}
    assert steps == pytest.approx({0: 0.0, 1: 0.0})


def test_columns_of_any_name_stay(spark):
    names = ["base", "rest", "chain", "n_rest", "word", "logs", "found", "_row", "_j", "_own", "c0"]
    docs = documents(spark, [(0, "a b a"), (1, None)], **{name: name for name in names})
    got = hmm.score(docs, hmm.fit(docs)).collect()
    assert len(got) == 2 and all(r[name] == name for r in got for name in names)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {0: 4, 1: 1}


def test_rounds_leave_neither_shuffle_files_nor_copies_of_the_chain(spark):
    docs = documents(spark, [(k, f"a b w{k} c") for k in range(200)]).repartition(4)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def standing():
        shuffles = {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
        return shuffles, set(glob.glob(os.path.join(spark.sparkContext._temp_dir, "tmp*")))

    before = standing()
    model = hmm.fit(docs)
    for _ in range(50):
        left = [now - old for now, old in zip(standing(), before)]
        if not left[0]:
            break
        time.sleep(0.1)
    # The vocabulary is one copy, the chains of the seven rounds are gone.
    assert not left[0] and len(left[1]) <= 1
    assert hmm.score(docs, model).count() == 200


def test_words_of_a_column_are_those_of_its_texts(monkeypatch):
    monkeypatch.setattr(hmm, "SLICE_BYTES", 16)
    letters = [chr(k) for k in range(128)] + ["\x85", "\xa0", "\u2003", "\u00c4", "\u00df", "\U0001f642"]
    texts = ["", None, " ", *(f" A{c}B{c}{c} c{c}" for c in letters), "word " * 50, " x"]
    got = []
    for part in hmm._slices(pa.array(texts)):
        words, owners = hmm._words(part)
        got += [[w.encode() for k, w in zip(owners, words.to_pylist()) if k == n] for n in range(len(part))]
    assert got == [hmm.tokens((t or "").encode()) for t in texts]


def test_long_sequences_do_not_underflow():
    rng = np.random.default_rng(2)
    chain = hmm.Chain(np.full(3, 1 / 3), np.array([[1 - 2e-9, 1e-9, 1e-9], [0.2, 0.3, 0.5], [1e-9, 0.5, 0.5]]), rng.dirichlet(np.full(50, 0.05), 3).T + 1e-12)
    seen = [rng.integers(0, 50, n).astype(np.int32) for n in (3000, 1, 700, 2)]
    sums = np.zeros(3), np.zeros((3, 3)), np.zeros((50, 3))
    chain.expectations(seen, sums)
    assert sums[0].sum() == pytest.approx(4) and sums[1].sum() == pytest.approx(sum(map(len, seen)) - 4)
    assert np.allclose(sums[2].sum(1), np.bincount(np.concatenate(seen), minlength=50))
    for s, got in zip(seen, chain.log10_likelihood(seen)):
        state, want = chain.start * chain.emit[s[0]], 0.0
        for k in range(1, len(s)):
            want, state = want + math.log10(state.sum()), (state / state.sum()) @ chain.step * chain.emit[s[k]]
        assert got == pytest.approx(want + math.log10(state.sum()))


def test_only_one_array_of_a_whole_group_is_held():
    """The pass forward; emissions and the pass back are held block by block."""
    rng = np.random.default_rng(3)
    chain = hmm.Chain.first(np.arange(1, 101.0), hmm.STATES)
    seen = [rng.integers(0, 100, 512).astype(np.int32) for _ in range(hmm.GROUP_TOKENS // 512)]
    sums = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((100, hmm.STATES))
    whole = 8 * hmm.STATES * hmm.GROUP_TOKENS
    tracemalloc.start()
    chain.expectations(seen, sums)
    after_passes = tracemalloc.get_traced_memory()[1]
    chain = hmm.Chain.first(np.arange(1, 101.0), hmm.STATES)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    chain.log10_likelihood(seen)
    after_scores = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert after_passes < 2 * whole and after_scores < whole
    assert sums[2].sum() == pytest.approx(hmm.GROUP_TOKENS)


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [None, "", *(" ".join(f"w{k}" for k in rng.zipf(1.5, n) % 50) for n in rng.integers(1, 60, 80))]
    docs = documents(spark, list(enumerate(texts))).coalesce(1)
    monkeypatch.setattr(hmm, "KNOWN_WORDS", 20)

    def results():
        model = hmm.fit(docs)
        return model.counts.orderBy("word").collect(), hmm.score(docs, model).orderBy("doc_id").toPandas()

    counts, scores = results()
    for chunk, size in ((1, 1), (7, 100), (1 << 12, 300)):
        monkeypatch.setattr(hmm, "CHUNK_TOKENS", chunk)
        monkeypatch.setattr(hmm, "SLICE_BYTES", size)
        again, others = results()
        assert again == counts
        for name in scores:
            assert np.allclose(others[name], scores[name], rtol=1e-6)
