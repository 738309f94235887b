"""Mixing sources to target weights (operator 7).

Sizes are words; each source's words are summed with partial aggregation, targets and repetition rates follow
from the per-source totals, and each document is taken floor(rate) times plus once more if its hash-seeded draw is
below the fraction. The draw depends on doc_id alone, so reruns and retried tasks agree and no source meets in one task.

Defined results: null text has size 0; the null source is a source of its own, ordered last; a null doc_id draws as
the text "null"; repeated rows draw alike. A source of size 0 has target 0. Sources with equal cap per weight are capped in the order of
their names. An empty table gives an empty result. Other columns of docs are not read by mix; repeat_to_mix returns them unchanged,
whatever their names. Long texts are counted whole, in the JVM. Targets are found in one task, on one row per source: that suits up to some millions of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD_CLASS, numbered, opened, stage, stage_whole

#: A source is repeated this many times at most.
MOST_REPEATS = 3
SEED = "mix-1"


def draw(doc_id: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an MD5 of the id and the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{SEED}")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> target. Weights 1, 2, 3, repeating, share the total; targets stop at MOST_REPEATS times
    the size. Sharing the excess again until none is above ends with the sources of least cap per weight capped and
    one common level for the rest, so sorted running sums find it in one pass. One row per source, not per document."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", MOST_REPEATS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "total": F.sum("source_size").over(whole), "weights": F.sum("weight").over(whole),
    })
    # a source is below its cap if the level reached with all before it capped is below its own cap per weight
    w = w.withColumn("open", F.col("weight") * (F.col("total") - F.col("capped")) < F.col("cap") * (F.col("weights") - F.col("gone")))
    level = F.min(F.when(F.col("open"), F.struct("gone", "capped"))).over(whole)
    w = w.withColumn("level", level)
    share = (F.col("weight") * (F.col("total") - F.col("level.capped"))).cast("double") / (F.col("weights") - F.col("level.gone"))
    return w.select("source", "source_size", F.least(F.coalesce(share, F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def copies(rate: Column, doc_id: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id) < rate - whole, 1).otherwise(0)).cast("int")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, __row, source, size, source_size, target, copies, taken."""
    return portion(spark, numbered(docs, "doc_id", "source", "text"))


def portion(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """mix of rows that have their numbers."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    sized = stage(spark, rows.select("doc_id", "__row", "source", size.alias("size")), "sizes")
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumnRenamed("source", "__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = sized.join(per, F.col("source").eqNullSafe(F.col("__source"))).withColumn("copies", copies(rate, F.col("doc_id")))
    return out.select("doc_id", "__row", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat_to_mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Texts without words carry no size; they are taken once."""
    rows = stage_whole(spark, docs)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    plan = portion(spark, rows.select("doc.doc_id", "doc.source", "doc.text", "__row")).select("__row", times.alias("times")).filter("times > 0")
    return opened(rows.join(plan, "__row").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("times")))))
