"""Registered queries of this subpackage: thin wrappers that give the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.llm import balltree, chunks, conversations, embedding_dedup, line_dedup, lm, mixing, mtree, oracle, packing, quality, secrets, simhash, toxicity
from prioscope.llm.common import table
from prioscope.session import materialize


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunks.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("cut_spans").alias("n_cut"),
                      F.aggregate("cut_spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).alias("chars_cut"), "cut_spans")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = lm.held_out("doc_id", 3, 1)
    got = toxicity.score(docs, toxicity.fit(docs, labels.where(~out)))
    return got.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.quantised(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(vectors.where("vec_id % 100 = 0"), vectors, 10)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), lm.held_out("doc_id")
    training = docs.where(~out)
    counts = materialize(lm.word_counts(training), "counts")
    model = lm.fit(training, counts)
    return lm.score(docs, model, counts).select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 20)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = lm.held_out("doc_id", 5, 0)
    got = quality.score(docs, quality.fit(docs, labels.where(~out)))
    return got.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_secret_scan, op3_toxicity, op4_best_fit_packing, op5_simhash_dedup, op6_embedding_dedup,
    op7_line_dedup, op8_top_k, op9_lm_score, op10_mix, op11_lexical_search, op12_conversation_repair, op13_quality, pipeline)}

#: DuckDB SQL of the queries that SQL can express. The base patterns' spans, the tokenizer's
#: ids, XXH64 fingerprints, models and searches are tested against brute force instead.
ORACLE_SQL = {
    "op11_lexical_search": oracle.LEXICAL_SEARCH,
    "op12_conversation_repair": oracle.CONVERSATION_REPAIR,
    "op10_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM s),
o AS (SELECT *, 3.0 * n / weight AS ratio, row_number() OVER (ORDER BY 3.0 * n / weight, rank) AS k FROM w),
p AS (SELECT *, sum(n) OVER () AS total,
             coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
l AS (SELECT min_by((total - capped) / free, k) AS unit, min(k) AS first_free FROM p WHERE (total - capped) / free <= ratio),
t AS (SELECT source, CAST(n AS BIGINT) AS source_size, CAST(CASE WHEN k < first_free THEN 3.0 * n ELSE unit * weight END AS DOUBLE) AS target FROM p, l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(floor(target) / source_size) END AS epochs,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - start_at)) AS BIGINT) AS taken FROM r
""",
}
