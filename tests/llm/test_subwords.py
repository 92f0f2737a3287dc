import numpy as np

from chromaloom.llm import queries, subwords
from tests.llm.helpers import SF_DIR, documents, fold, needs_tables, sql


def model():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(subwords.ROWS, subwords.DIM)).astype(np.float32)
    return subwords.Model(vectors, rng.normal(size=(2, subwords.DIM)), np.array([0.1, -0.2]))


def test_score_is_the_softmax_of_the_mean_vector():
    """The buckets' vectors averaged one by one, then the output layer."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(subwords.ROWS, subwords.DIM)).astype(np.float32)
    output, bias = rng.normal(size=(2, subwords.DIM)), np.array([0.1, -0.2])
    data = np.frombuffer(b" Some words, words words! ", np.uint8)
    buckets = np.concatenate([b for _, b in subwords.Features().of(data, np.array([len(data)]))])
    raw = np.exp(output @ vectors[buckets].mean(0) + bias)
    assert np.isclose(model().score(["Some words, words words!"])[0], raw[1] / raw.sum(), atol=1e-5)


def test_features_of_a_word():
    features = subwords.Features()
    data = np.frombuffer(b"  abcd ab  ab ", np.uint8)
    words, pairs, three, four = features.of(data, np.array([len(data)]))
    assert words[0].tolist() == [2, 7, 11] and words[1][1] == words[1][2] != words[1][0]
    assert pairs[1].tolist() == [subwords.DIFFERENT, subwords.SAME]
    # " ab", "abc", "bcd", "cd " and " ab", "ab " twice; " abc", "abcd", "bcd ". No n-gram holds a blank
    # inside, and one from blank to blank would be the word itself.
    assert len(three[0]) == 8 and len(four[0]) == 3


def test_neighbours_in_a_batch_do_not_matter():
    texts = ["a b c", None, "", "long word " * 30_000, "x", "b b"]
    own = [float(model().score([t])[0]) for t in texts]
    assert np.allclose(model().score(texts), own, atol=1e-9)
    assert own[1] == own[2]


def test_training_separates_a_simple_rule():
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["fine", "clear", "text", "here"], 20)) for _ in range(60)]
    bad = [" ".join(rng.choice(["fine***", "clear###", "text$$$", "here"], 20)) for _ in range(60)]
    learned = subwords.Model(*subwords.train(good + bad, np.array([1] * 60 + [0] * 60)))
    scores = learned.score(good + bad)
    assert scores[:60].min() > 0.7 > 0.5 > scores[60:].max()


def test_labels_with_nulls_repeats_and_none_at_all(spark):
    docs = documents(spark, [(1, "good words"), (2, "bad***"), (3, None), (None, "x"), (1, "good words")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, None), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    learned = subwords.fit(docs, labels)
    scores = [r[0] for r in docs.select(subwords.score_column(spark, learned)).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores) and scores[0] == scores[4]
    assert subwords.fit(docs, labels.where("false")) is None
    assert docs.select(subwords.score_column(spark, None)).first()[0] == 0.5
    assert documents(spark, []).select(subwords.score_column(spark, learned)).count() == 0


@needs_tables
def test_query_on_held_out_documents(spark):
    got = queries.op9_quality(spark, SF_DIR).toPandas().merge(sql("SELECT doc_id, quality FROM labels").df(), on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda k: fold(k, 4) == 2)).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.8
