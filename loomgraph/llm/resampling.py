"""Target-distribution importance resampling (operator 12): hashed n-gram weights, Gumbel scores, distributed LSD radix sort.

1. Features of a text are its runs of 1 to 3 words; each falls into one of BUCKETS buckets by its CRC-32. Words are hashed once; a run's CRC-32 follows from those of its
   words, since the CRC of two joined strings is a linear function of the first one's, taken from tables.
2. Each task counts its buckets in one array and emits it; BUCKETS rows a task are summed up by Spark, for the documents and for the target.
3. A bucket's gain is its log ratio, floored to thousandths. The gains are one array of BUCKETS numbers, the only thing that is sent to all tasks; a
   document's weight is the sum of gains over its features.
4. A Gumbel number from a hash of the id is added. The best scores are drawn without replacement; their order, ties to the smaller id, comes from
   a distributed radix sort of all candidates (radix.py), whose last positions are the ranks.

Defined results: null counts as empty, without features, with weight 0. A null doc_id is hashed as the text "42:null" and comes last in ties. Repeated rows are candidates of their
own and are drawn one by one, in the order of the table's files. Very long texts and words are hashed whole. An empty table gives an empty result; without a target
all gains follow from its zero counts. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Memo, slices, stage, texts
from loomgraph.llm.radix import radix_ranks

BUCKETS = 10_000
NGRAMS = 3
FEWEST_WORDS = 20
PERCENT = 5
SEED = 42
#: What is no word: ASCII but for digits and lower-case letters; A-Z are lowered first.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
LONGEST = 64  # bytes of a word whose shift is tabulated; longer ones are shifted step by step
COUNTS = "bucket int, n bigint"
FEATURES = "__row bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint"


def shift_tables(most: int) -> np.ndarray:
    """[k, byte, value]: what a CRC-32 becomes when k zero bytes follow it, byte by byte of its value."""
    step = np.zeros((4, 256), np.uint32)
    for b in range(4):
        for v in range(256):
            x = v << (8 * b)
            for _ in range(8):
                x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
            step[b, v] = x
    out = np.zeros((most + 1, 4, 256), np.uint32)
    for b in range(4):
        out[0, b] = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
    for k in range(1, most + 1):
        before = out[k - 1]
        out[k] = step[0][before & 255] ^ step[1][(before >> 8) & 255] ^ step[2][(before >> 16) & 255] ^ step[3][before >> 24]
    return out


_SHIFT = shift_tables(LONGEST + 1)


def shifted(crc: np.ndarray, k: np.ndarray) -> np.ndarray:
    """CRCs followed by k zero bytes each."""
    crc, k = crc.copy(), k.copy()
    while True:
        now = np.minimum(k, LONGEST + 1)
        crc = _SHIFT[now, 0, crc & 255] ^ _SHIFT[now, 1, (crc >> 8) & 255] ^ _SHIFT[now, 2, (crc >> 16) & 255] ^ _SHIFT[now, 3, crc >> 24]
        k = k - now
        if not k.any():
            return crc


def hashed_word(word: bytes) -> int:
    """CRC-32 of the word, and its length, in one number."""
    return len(word) << 32 | zlib.crc32(word)


def buckets(some: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of several texts, in no order within a text; words and features of each text."""
    words = [x.translate(_CLEAN).split() for x in some]
    n = np.array([len(w) for w in words], np.int64)
    packed = np.fromiter((memo[w] for one in words for w in one), np.uint64, int(n.sum()))
    crc, size = packed.astype(np.uint32), (packed >> np.uint64(32)).astype(np.int64)
    ends = np.repeat(np.cumsum(n), n)
    at, parts, owner = np.arange(len(crc)), [crc % BUCKETS], [np.repeat(np.arange(len(n)), n)]
    joined = crc
    for k in range(1, NGRAMS):
        keep = at + k < ends[at]
        at, joined = at[keep], joined[keep]
        # what was joined, a space, the next word
        joined = shifted(shifted(joined, np.ones(len(at), np.int64)) ^ np.uint32(zlib.crc32(b" ")), size[at + k]) ^ crc[at + k]
        parts.append(joined % BUCKETS)
        owner.append(owner[0][at])
    features = sum((np.maximum(n - k, 0) for k in range(NGRAMS)), np.zeros(len(n), np.int64))
    return np.concatenate(parts).astype(np.int64), np.concatenate(owner), np.stack([n, features])


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that a task meets."""
    memo, total = Memo(hashed_word), np.zeros(BUCKETS, np.int64)
    for batch in slices(batches):
        memo.trim()
        total += np.bincount(buckets(texts(batch), memo)[0], minlength=BUCKETS)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame) -> DataFrame:
    return docs.select("text").mapInArrow(count, COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket. Its BUCKETS rows are all that reaches the driver."""
    side = lambda df, name: bucket_counts(df).withColumnRenamed("n", name)
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(side(docs, "s"), "bucket", "left").join(side(target, "t"), "bucket", "left").na.fill(0)
    rows = both.select("bucket", "s", "t").collect()
    out = np.zeros((2, BUCKETS))
    for r in rows:
        out[:, r["bucket"]] = r["s"], r["t"]
    s, t = out
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """FEATURES of docs (__row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(hashed_word)
        for batch in slices(batches):
            memo.trim()
            some = texts(batch)
            bucket, owner, (words, features) = buckets(some, memo)
            weight = np.zeros(len(some), np.int64)
            np.add.at(weight, owner, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), pa.array(features), pa.array(weight)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return docs.select("__row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FEATURES)


def gumbel(doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the SHA-256 of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, fewest_words: int = FEWEST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn). docs has doc_id and text, target has text."""
    gain = gains(spark, docs, target)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row"))
    scored = stage(spark, weigh(rows, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))), "scores")
    able = scored.filter(F.col("n_words") >= fewest_words)
    # a row behind each null id: no long is greater than the last key of an id
    keys = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0).cast("long"))]
    drawn = able.count() * percent // 100
    ranks = radix_ranks(spark, able.select("__row", "score", "doc_id"), keys, "__row").filter(F.col("rank") <= drawn)
    return scored.join(ranks, "__row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
