"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, brown, exact_dedup, mixing, periodic_runs, private_data, quality_classifier, quality_rules, resampling, simhash, substring_dedup, token_counts, toxicity
from loomgraph.llm.common import crc_mod, documents


def vocabulary() -> str:
    """The vocabulary file: LOOMGRAPH_VOCABULARY, or that of the installed package of public tokenizers."""
    if found := os.environ.get("LOOMGRAPH_VOCABULARY"):
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(modulus: int, remainder: int = 0):
    return F.coalesce(crc_mod("doc_id", modulus) == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = toxicity.train(spark, docs, labels(spark, sf_dir))
    return toxicity.score_documents(docs, net).select("doc_id", held_out(toxicity.FOLDS).alias("held_out"), "score", "predicted", "language")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_in_batches(spark, documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), vocabulary())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_classifier.train(spark, docs, labels(spark, sf_dir))
    return quality_classifier.classify(docs, model).select("doc_id", held_out(quality_classifier.FOLDS).alias("held_out"), "expected_grade", "tail_probability", "selected")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_duplicates(spark, documents(spark, sf_dir))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "passages", F.transform("passages", lambda p: p["partner"]).alias("partner_ids"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_edited(spark, documents(spark, sf_dir), vocabulary())


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.brown_scores(spark, documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.planted(documents(spark, sf_dir))).withColumn("best", periodic_runs.longest(F.col("runs")))
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    hashed = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, hashed(periodic_runs.listed(F.col("runs"))).alias("runs_sha256"), hashed(F.col("collapsed")).alias("collapsed_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.importance_resample(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.private_data(documents(spark, sf_dir))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    counts = [private_data.counted(spans, k, True).alias(f"n_{k}") for k in private_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(private_data.told(base).cast("binary"), 256).alias("base_sha256"), private_data.told(spans).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_exact_dedup, op3_simhash, op4_bpe, op5_quality_classifier, op6_substring_dedup, op7_mixing, op8_quality_rules, op9_token_counts, op10_lm_scoring, op11_periodic_runs, op12_importance_resampling, op13_private_data)}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id NULLS LAST) AS k,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""

#: Common table expressions of the mix, shared with the pipeline's parts that SQL can express.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s
), o AS (
  SELECT *, coalesce(CAST(sum(cap) OVER b AS BIGINT), 0) AS capped, coalesce(CAST(sum(weight) OVER b AS BIGINT), 0) AS gone,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT gone AS l_gone, capped AS l_capped FROM o WHERE weight * (total - capped) < cap * (weights - gone) ORDER BY gone, capped LIMIT 1
), t AS (
  SELECT source, source_size, least(coalesce(CAST(weight * (total - l_capped) AS DOUBLE) / (weights - l_gone), CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target
  FROM o LEFT JOIN l ON true
), c AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) * size AS taken FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op7_mixing": OP7_SQL}
