"""Folds over ordered streams of keys of any size: no key's rows meet in one task.

Rows are ranged by key and order and cut into segments, wherever the cuts fall. A segment is summed up alone; summaries, short and one for each segment, are composed
along each key; then each segment is replayed from the state that its key has when it begins. So work is spread however hot a key is, and results do not
depend on the cuts, so neither lost executors nor another number of tasks change them. Ranged rows are written to the shared folder once and read three times."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.tables import stage

#: Rows of a segment at most; a segment is held in the memory of one Python worker. 2^SEGMENT_BITS of them.
SEGMENT_BITS = 16


def ranged(spark: SparkSession, rows: DataFrame, key: list[str], order: list[str], name: str, bits: int = SEGMENT_BITS) -> DataFrame:
    """The rows with __segment, which rises along key and order; a segment is at most 2^bits rows of one task, and may hold several keys."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    return stage(spark, cut.withColumn("__segment", F.shiftright(F.monotonically_increasing_id(), bits)), name)


def running_total(spark: SparkSession, rows: DataFrame, order: list[str], size: Column, bits: int = SEGMENT_BITS) -> DataFrame:
    """The rows with position (1, 2, ...) and total (the sum of sizes so far, null counting as 0) in that order, which must tell all rows apart. Sums of segments are added
    up first (one row for each of them), then the rows inside each segment, so no task holds more than a segment."""
    cut = ranged(spark, rows.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0))), [], order, "ranged", bits)
    sums = cut.groupBy("__segment").agg(F.count("*").alias("n"), F.sum("__size").alias("s"))
    before = Window.orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_before"))
    inside = Window.partitionBy("__segment").orderBy(*order)
    out = cut.withColumn("__n", F.row_number().over(inside)).withColumn("__s", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(offsets, "__segment")
    return out.select(*rows.columns, (F.col("n_before") + F.col("__n")).alias("position"), (F.col("s_before") + F.col("__s")).alias("total"))


def _groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows as tuples, grouped by their first n columns, which come sorted."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda r: r[:n])


def _packed(rows: Iterator[tuple], columns: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    while some := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some), columns, strict=True)], names=[n for n, _ in columns])


def segmented(
    spark: SparkSession, rows: DataFrame, key: str, order: list[str], columns: list[str], summary: Callable[[list[tuple]], Any], compose: Callable[[Any, Any], Any],
    replay: Callable[[Any, list[tuple]], Iterator[tuple]], out: str, start: Any = None, bits: int = SEGMENT_BITS,
) -> DataFrame:
    """Fold each key's rows in order. summary(rows) tells what a segment does, compose(state, summary) the state behind it, replay(state, rows) its results, as tuples of
    the columns named in out (key is put before them). Rows come as tuples of columns; states and summaries are what JSON can hold. Null keys are a key of their own."""
    base = ranged(spark, rows.select(F.col(key).alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("v")), ["k"], [f"o{i}" for i in range(len(order))], "segments", bits)
    ordered = [f"o{i}" for i in range(len(order))]
    kind = base.schema["k"].dataType.simpleString()

    def take(value: dict) -> tuple:
        return tuple(value[c] for c in columns)

    result = spark.createDataFrame([], f"__k {kind}, {out}").schema
    types = [to_arrow_type(f.dataType) for f in result]
    said = [("k", types[0]), ("__segment", pa.int64()), ("said", pa.string())]
    kinds = f"k {kind}, __segment bigint, said string"

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(((*at, json.dumps(summary([take(r[2]) for r in some]))) for at, some in _groups(batches, 2)), said)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def states() -> Iterator[tuple]:
            for (k,), some in _groups(batches, 1):
                state = start
                for _, segment, done in some:
                    yield k, segment, json.dumps(state)
                    state = compose(state, json.loads(done))

        return _packed(states(), said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for (k, _), some in _groups(batches, 2):
                first = next(some)  # the state
                for row in replay(json.loads(first[3]), [take(r[4]) for r in some]):
                    yield k, *row

        return _packed(found(), list(zip(result.fieldNames(), types)))

    by_segment = base.select("k", "__segment", "v", *ordered).repartition("k", "__segment").sortWithinPartitions("k", "__segment", *ordered)
    sums = by_segment.select("k", "__segment", "v").mapInArrow(sum_up, kinds)
    states = stage(spark, sums.repartition("k").sortWithinPartitions("k", "__segment").mapInArrow(carry, kinds), "states")
    none = F.lit(None)
    begins = states.select("k", "__segment", F.lit(0).alias("tag"), "said", none.cast(base.schema["v"].dataType).alias("v"), *[none.cast(base.schema[o].dataType).alias(o) for o in ordered])
    both = begins.unionByName(base.select("k", "__segment", F.lit(1).alias("tag"), none.cast("string").alias("said"), "v", *ordered))
    both = both.repartition("k", "__segment").sortWithinPartitions("k", "__segment", "tag", *ordered).select("k", "__segment", "tag", "said", "v")
    return both.mapInArrow(run, result).withColumnRenamed("__k", key)
