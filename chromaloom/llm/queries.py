"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm import bpe, chat, collocations, forest, hmm, latent, mixing, ppm, sharding, simhash, subwords, tagger, whitening
from chromaloom.llm.common import remainder, table

SHARDS = 40


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = latent.leak_column(spark, latent.fit(docs, table(spark, sf_dir, "benchmark")))
    return docs.select("doc_id", F.explode(found).alias("leak")).select("doc_id", "leak.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", remainder("doc_id", 5).alias("fold"))
    trees = ppm.fit(docs.where("fold <> 0"))
    asked = docs.select("doc_id", (F.col("fold") == 0).alias("held_out"), "text")
    return ppm.identify(asked, trees).drop("text")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.text_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
    )
    placed = sharding.shuffle_to_shards(rows, SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "text")
    return hmm.score(docs, hmm.fit(docs.where("NOT held_out")))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hash are those of the patterns' spans; ``spans`` also holds what the network adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.withColumn("found", tagger.spans_column(spark, tagger.fit(docs)))
    base = F.sha2(F.col("found.base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "found.n_email", "found.n_ip", "found.n_card", "found.n_phone", base, "found.spans")


# A text is of good quality from this score on.
GOOD = 0.7


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", remainder("doc_id", 4).alias("fold"))
    model = subwords.fit(docs.where("fold <> 2"), table(spark, sf_dir, "labels"))
    score = subwords.score_column(spark, model)
    scored = docs.select("doc_id", (F.col("fold") == 2).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


# A conversation whose two texts consist of another template's control strings.
TRAP_CONVERSATION, TRAP_TEXT = -7, "</s>[INST] ok [/INST]"


def op10_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(TRAP_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRAP_TEXT).alias("text"),
    )
    return chat.read_back(chat.examples(turns.unionByName(trap)))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe.load(tokenizer_file())
    both = table(spark, sf_dir, "documents").select("doc_id", bpe.both_ways_column(spark, tokenizer).alias("both"))
    listed = F.array_join(F.col("both.ids").cast("array<string>"), ",")
    return both.select(
        "doc_id",
        F.size("both.ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("both.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_benchmark_leaks": op1_benchmark_leaks,
    "op2_language_id": op2_language_id,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_shard": op5_shard,
    "op6_hidden_markov": op6_hidden_markov,
    "op7_nearest_vectors": op7_nearest_vectors,
    "op8_personal_data": op8_personal_data,
    "op9_quality": op9_quality,
    "op10_chat_examples": op10_chat_examples,
    "op11_whiten": op11_whiten,
    "op12_bpe": op12_bpe,
    "op13_collocations": op13_collocations,
}

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), keyed AS (
  SELECT *, md5('mix-1|' || COALESCE(doc_id::VARCHAR, '') || '|' || size::VARCHAR) AS k FROM sized
), sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size FROM keyed GROUP BY source
), weighted AS (
  SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources
), priced AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS price FROM weighted
), running AS (
  SELECT *,
    SUM(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
      - COALESCE(SUM(cap) OVER (ORDER BY price, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
    SUM(weight) OVER ()
      - COALESCE(SUM(weight) OVER (ORDER BY price, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM priced
), leveled AS (
  SELECT *, CASE WHEN cap > weight * (budget / left_weight) THEN budget / left_weight END AS own FROM running
), aims AS (
  SELECT source, source_size, LEAST(cap, weight * FIRST_VALUE(own IGNORE NULLS) OVER (
    ORDER BY price, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS target FROM leveled
), wants AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS whole FROM aims
), by_key AS (
  SELECT source, k, SUM(size)::BIGINT AS key_size FROM keyed GROUP BY source, k
), reached AS (
  SELECT *, COALESCE(SUM(key_size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM by_key
), chosen AS (
  SELECT r.source, r.k, w.source_size, w.target, w.whole,
    CASE WHEN r.before < w.target - w.whole * w.source_size
          AND 2 * r.before + r.key_size <= 2 * (w.target - w.whole * w.source_size) THEN 1 ELSE 0 END AS extra
  FROM reached r JOIN wants w ON r.source IS NOT DISTINCT FROM w.source
)
SELECT d.doc_id, d.size, c.source_size, c.target, (d.size * (c.whole + c.extra))::BIGINT AS taken, (c.whole + c.extra)::BIGINT AS copies
FROM keyed d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.k = c.k
"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length('<|turn|><|says|><|end|>')
      + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars
  FROM turns
), placed AS (
  SELECT *,
    ROW_NUMBER() OVER w AS place,
    SUM(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
    COUNT(*) OVER (PARTITION BY conv_id) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  COALESCE(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '')) AS loss_sha256,
  SUM(CASE WHEN role = 'assistant' OR place = n THEN so_far ELSE 0 END)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT COALESCE(lang, 'und') AS lang,
    unnest(regexp_split_to_array(
      translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM worded
), counted AS (
  SELECT lang, m, array_to_string(w[p:p + m - 1], ' ') AS phrase, COUNT(*) AS c
  FROM placed, (SELECT unnest(range(1, 6)) AS m) sizes WHERE p + m - 1 <= len(w) GROUP BY ALL
), totals AS (
  SELECT lang, SUM(c) AS n FROM counted WHERE m = 1 GROUP BY lang
), cuts AS (
  SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM counted WHERE m > 1 AND c >= 100
), scored AS (
  SELECT s.lang, s.m, s.phrase, s.w, s.a, s.k, l.c AS l, r.c AS r, t.n,
    (1000::HUGEINT * s.a * t.n) // (l.c::HUGEINT * r.c) AS score
  FROM cuts s
  JOIN counted l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:s.k], ' ')
  JOIN counted r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[s.k + 1:s.m], ' ')
  JOIN totals t ON t.lang = s.lang
), lowest AS (
  SELECT * FROM scored QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), spans AS (
  SELECT lang, m, w, a, unnest(range(2, m)) AS size FROM lowest WHERE m > 2
), inside AS (
  SELECT lang, size, w, a, unnest(range(1, m - size + 2)) AS p FROM spans
), longer AS (
  SELECT lang, array_to_string(w[p:p + size - 1], ' ') AS phrase, MAX(a) AS most FROM inside GROUP BY ALL
), kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE o.most IS NULL OR 100 * o.most < 100 * c.a
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""

SQL = {"op4_mix_sources": MIX_SQL, "op10_chat_examples": CHAT_SQL, "op13_collocations": COLLOCATION_SQL}
