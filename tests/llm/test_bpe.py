import hashlib
import random
import sys
import types

import numpy as np
import pyarrow as pa
import pytest

from chromaloom.llm import bpe, common, queries
from tests.llm.helpers import SF_DIR, documents, needs_tables

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

PARTS = [
    "the", "Their", " ", "  ", "   ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "　", "don't", "'S", "we'll", "x'd",
    "12", "٣٤", "½", "é", "é", "ß", "ñandú", "中文", "ไทย", "🙂", "👩‍👧", "!!", "...", "_", "<|endoftext|>", "<|endof", "text|>",
    "՘", "\U00010940", "�", "\x00", "aaaaaaaa", "Ġ", "·×÷", "ɏ", "​",
]


@pytest.fixture(scope="module")
def own():
    return bpe.load(queries.tokenizer_file())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_file())


def test_encodes_and_decodes_like_the_library(own, library):
    rng = random.Random(3)
    texts = ["", *PARTS, *("".join(rng.choices(PARTS, k=rng.randint(1, 12))) for _ in range(3000))]
    words = ["Anblewh sttible", "éà", "Ǆǃ", "x×y", "÷", "no", "a.", "b!?", "\nEnd", " \n", "it's", "l'été,", "z'S"]
    texts += ["".join(rng.choice(words) + rng.choice([" ", "\n", ""]) for _ in range(9)) for _ in range(2000)]
    texts += ["".join(chr(c) for c in range(start, start + 64)) for start in range(0, 0xD800, 64)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == want, repr(text)
        assert own.decode(np.array(want, int)) == library.decode(want, skip_special_tokens=False) == text


def test_long_pieces_and_the_bounded_cache(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    text = "abcab" * 20_000 + " one two three four five one two" * 50
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_remembered_chunks_are_bytes_and_hold_little(own):
    own = bpe.load(queries.tokenizer_file())
    text = "\nOne two, three four! one two\n\n'tis <|endoftext|> no" * 3
    ids = own.encode(text)
    assert own.cache[" two"] == own.encode(" two").tobytes() and all(isinstance(v, bytes) for v in own.cache.values())
    assert max(map(sys.getsizeof, own.cache.values())) < 100
    assert ids.dtype == np.int32 and own.encode(text).tolist() == ids.tolist()


def test_workers_open_a_kept_value_once(spark):
    held = common.kept(spark, types.SimpleNamespace(tasks=0))

    def count(batches):
        for batch in batches:
            held().tasks += 1
            yield pa.RecordBatch.from_arrays([pa.array([held().tasks] * batch.num_rows, pa.int64())], ["n"])

    got = [r.n for r in spark.range(0, 64, 1, 64).mapInArrow(count, "n long").collect()]
    assert len(got) == 64 and max(got) > 1


def test_both_ways_at_once_equals_one_after_the_other(spark, own):
    pairs = [(1, "a b, c"), (1, "a b, c"), (2, None), (3, ""), (4, "\u00e9\U0001f642 <|endoftext|>")]
    docs = documents(spark, pairs).withColumn("both", bpe.both_ways_column(spark, own)).withColumn("ids", bpe.encode_column(spark, own))
    rows = docs.withColumn("back", bpe.decode_column(spark, own)).collect()
    assert len(rows) == 5 and all(r.both.ids == r.ids and r.both.decoded == r.back == (r.text or "") for r in rows)


def test_merges_follow_ranks_from_the_left(own, monkeypatch):
    """Against a plain loop that merges the lowest rank first, leftmost first."""

    bits = own.bits

    def plain(piece):
        symbols = [own.vocabulary[c] for c in piece]
        while True:
            pairs = [(own.merges[a << bits | b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if (a << bits | b) in own.merges]
            if not pairs:
                return symbols
            merge, k = min(pairs)
            symbols[k : k + 2] = [merge & ((1 << bits) - 1)]

    rng = random.Random(4)
    for _ in range(500):
        piece = "".join(rng.choices("aeinorstĠ", k=rng.randint(1, 40)))
        assert own.merge([own.vocabulary[c] for c in piece]) == plain(piece)


def test_ids_without_a_string_are_skipped_and_broken_bytes_replaced(own, library):
    broken = library.encode("🙂", add_special_tokens=False).ids
    for ids in ([10**6, 64, 50256], broken[:1], broken[:2] + [64], broken[::-1]):
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_other_kinds_of_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))


def test_columns_with_nulls_repeats_clashes_and_no_rows(spark, own):
    pairs = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x" * 5000)]
    docs = documents(spark, pairs, decoded="clash", n_tokens="clash")
    ids = docs.withColumn("ids", bpe.encode_column(spark, own))
    got = ids.withColumn("back", bpe.decode_column(spark, own)).collect()
    assert sorted((r.doc_id or 0, r.back) for r in got) == sorted((i or 0, t or "") for i, t in pairs)
    assert [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    assert all(r.decoded == r.n_tokens == "clash" for r in got)
    empty = docs.limit(0).withColumn("ids", bpe.encode_column(spark, own))
    assert empty.withColumn("back", bpe.decode_column(spark, own)).count() == 0
    lists = spark.createDataFrame([(None,), ([64, None, 10**6],)], "ids array<int>")
    assert [r[0] for r in lists.select(bpe.decode_column(spark, own)).collect()] == ["", "a"]


@needs_tables
def test_query_equals_the_library_on_whole_texts(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = queries.op12_bpe(spark, SF_DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for row in rows:
        ids = library.encode(docs[row.doc_id], add_special_tokens=False).ids
        listed = ",".join(map(str, ids))
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()
