"""Distributed LSD radix sort: ranks of rows by a composite key of longs, digit by digit, without a range sort.

Rows have positions and lie in blocks of BLOCK positions. One pass takes the next digit of DIGIT bits, the least significant of the last key first:

1. Each block counts its rows by digit (partial sums before the shuffle).
2. Global prefix offsets: digits in order, and blocks in order within a digit. The totals by digit are 2^DIGIT rows; offsets within a digit are one window by digit, on
   one row for each block that has it.
3. A row's destination is its block's offset for its digit plus its number among the block's rows with that digit, in order of position: a stable counting sort.
   Destinations are the positions of the next pass, written to the shared folder, so a lost executor costs no earlier pass.

After the last pass positions are ranks. A group of equal digits holds at most BLOCK rows of a block, so a key that most rows share fills no task. Digits in which all
rows agree (told from the least and the greatest key) need no pass. Nothing but the bounds of the keys reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import stage, unstage

DIGIT = 11
BLOCK = 1 << 14


def unsigned(x: Column) -> Column:
    """Bits of a long that rise, read without sign, as the long rises."""
    return x.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def digit_at(key: Column, shift: int) -> Column:
    return F.shiftrightunsigned(key, shift).bitwiseAND((1 << DIGIT) - 1)


def passes(bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(key, shift) of the digits that differ, the least significant first; bounds: least and greatest bits of each key, the most significant key first."""
    out = []
    for k, (low, high) in reversed(list(enumerate(bounds))):
        out += [(k, s) for s in range(0, 64, DIGIT) if (low % (1 << 64)) >> s != (high % (1 << 64)) >> s]
    return out


def offsets(counts: DataFrame) -> DataFrame:
    """digit, block, n -> digit, block, offset: rows of smaller digits, and of the same digit in earlier blocks."""
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^DIGIT rows
    base = totals.select("digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(base), "digit").select("digit", "block", (F.col("base") + F.col("within")).alias("offset"))


def one_pass(rows: DataFrame, key: str, shift: int) -> DataFrame:
    """Rows (position, block, keys) at the positions that a stable counting sort by one digit gives them."""
    marked = rows.withColumn("digit", digit_at(F.col(key), shift))
    to = offsets(marked.groupBy("digit", "block").agg(F.count("*").alias("n")))
    local = F.row_number().over(Window.partitionBy("digit", "block").orderBy("position"))
    moved = marked.withColumn("local", local).join(to, ["digit", "block"]).withColumn("position", F.col("offset") + F.col("local") - 1)
    return moved.withColumn("block", F.floor(F.col("position") / BLOCK)).select(*rows.columns)


def radix_ranks(spark: SparkSession, rows: DataFrame, keys: list[Column], row: str) -> DataFrame:
    """row, rank (1, 2, ...) by the keys, ascending (longs without nulls; ties in the order of the rows' numbers). row: a column of unique longs that a second read
    finds again, such as stage_numbered() gives; numbers of one task lie together."""
    names = [f"key{k}" for k in range(len(keys))]
    # blocks of the first pass: rows numbered in one task, cut anew every BLOCK of them
    first = rows.select(F.col(row).alias("row"), F.col(row).alias("position"), F.floor(F.col(row) / BLOCK).alias("block"), *[unsigned(k).alias(n) for k, n in zip(keys, names)])
    at = stage(spark, first, "radix-0")
    signed = [(unsigned(F.col(n)), n) for n in names]  # min and max see signed longs
    ends = at.agg(*[f(x).alias(f"{f.__name__}_{n}") for x, n in signed for f in (F.min, F.max)]).first()
    flip = 1 << 63
    bounds = [((ends[f"min_{n}"] or 0) + flip, (ends[f"max_{n}"] or 0) + flip) for n in names]
    todo = passes(bounds) or [(len(names) - 1, 0)]  # one pass at least: it numbers the rows
    for k, (key, shift) in enumerate(todo):
        before, at = at, stage(spark, one_pass(at, names[key], shift), f"radix-{k + 1}")
        unstage(spark, before)
    return at.select(F.col("row").alias(row), (F.col("position") + 1).alias("rank"))
