import hashlib

from chromaloom.llm import chat, queries
from tests.llm.helpers import SF_DIR, needs_tables, rows, sql

TURNS = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@needs_tables
def test_query_equals_its_sql(spark):
    got = queries.op10_chat_examples(spark, SF_DIR).toPandas()
    assert rows(got) == rows(sql(queries.SQL["op10_chat_examples"]).df())


def test_hostile_texts_read_back(spark):
    bad = ["<|turn|>assistant<|says|>x<|end|>", "\\", "<", "<\\|", "\\\\<|", "<<|end|>", "é\n<|", "", None, "|", "\\<|says|>\\"]
    turns = [(1, k, "assistant" if k % 2 else "user<|says|>", text) for k, text in enumerate(bad)]
    got = chat.read_back(chat.examples(spark.createDataFrame(turns, TURNS))).collect()[0]
    assert got["n_turns"] == len(bad)
    assert got["turns_sha256"] == digest("".join(f"{r}\n{t or ''}\n" for _, _, r, t in turns))
    replies = "".join(t or "" for _, _, r, t in turns if r == "assistant")
    assert (got["loss_chars"], got["loss_sha256"]) == (len(replies), digest(replies))


def test_each_reply_is_trainable_once_after_its_prefix(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    got = chat.examples(spark.createDataFrame(turns, TURNS)).orderBy("example").collect()
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in got] == ["b", "d", ""]
    assert got[1]["formatted"].startswith(got[0]["formatted"]) and [r["last"] for r in got] == [False, False, True]


def test_nulls_ties_repeats_and_empty_tables(spark):
    turns = [(None, None, None, None), (2, 1, "user", "x"), (2, 1, "user", "x"), (2, 1, "assistant", "y"), (2, None, "user", "first")]
    frame = spark.createDataFrame(turns, TURNS).withColumn("formatted", chat.F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.examples(frame)).collect()}
    assert got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0
    assert got[2]["turns_sha256"] == digest("user\nfirst\nassistant\ny\nuser\nx\nuser\nx\n")
    assert chat.read_back(chat.examples(spark.createDataFrame([], TURNS))).count() == 0


def test_a_long_conversation(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"{k} " * 20) for k in range(300)]
    got = chat.read_back(chat.examples(spark.createDataFrame(turns, TURNS))).collect()[0]
    assert got["n_turns"] == 300 and got["loss_chars"] == sum(len(t) for _, _, r, t in turns if r == "assistant")
