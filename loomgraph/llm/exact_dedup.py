"""Exact dedup with a persistent digest index (operator 2).

The index is a table bucketed and sorted by digest. A batch of new rows is reduced to one candidate per
digest (partial aggregation, so a group of copies that holds a third of all rows never meets in one task), the
candidates are anti-joined to the index by sort-merge join, and those that are new are appended.

Defined results: null text counts as empty; texts of white space only are copies of the empty text. Null ids
come last in a tie. Of rows equal in text and id exactly one is kept (the first in the table's file order).
Long texts are hashed whole, in the JVM. An empty table gives an empty result. Other columns are never read, so their names can't
clash; keep_first_copies returns them unchanged.
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE_CLASS, create, numbered, opened, remove, shared_dir, stage, stage_whole, unstage

INDEX_SCHEMA = "digest binary, keep_id bigint, keep_row bigint, chars int, first_batch string"


def first_row() -> Column:
    """Of a group of copies, the row that stays."""
    return F.min(F.struct((-F.col("chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("__row")))


def indexed_row() -> Column:
    """An entry of the index, as first_row() orders rows."""
    return F.struct((-F.col("chars")).alias("n"), F.col("keep_id").isNull().alias("no_id"), F.col("keep_id").alias("doc_id"), F.col("keep_row").alias("__row"))


class DigestIndex:
    """A bucketed and sorted table of the digests seen so far, each with the row that stays. It lives in a folder, so any later session that
    opens the folder goes on with it, whatever catalog it has; the number of buckets is that of the session that made it."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.table = f"digest_index_{hashlib.md5(self.folder.encode()).hexdigest()}"
        self.buckets = self._opened() or self._made(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/rows'"
        )

    def _opened(self) -> int | None:
        try:
            found = self.spark.read.schema("buckets int").json(f"{self.folder}/made").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return found and found["buckets"]

    def _made(self, buckets: int) -> int:
        self.spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").json(f"{self.folder}/made")
        return buckets

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, digests: DataFrame, batch: str, retry: bool = False, better: bool = False) -> None:
        """Append what is new in digests (digest, doc_id, chars, __row). A batch's name is taken when it begins; only a retry, which says that it is one, may use it again, and
        adds nothing that is there already. better: a row that goes before the one the index has is appended as well (best() tells which one stays); without it, what came first stays."""
        if not create(self.spark, f"{self.folder}/batches/{quote(batch, safe='')}", batch) and not retry:
            raise ValueError(f"batch {batch!r} is in the index already; a retry of it must say so")
        # written, because Catalyst would push the anti-join below the aggregation, where a group's copies all meet in one task
        best = stage(self.spark, digests.groupBy("digest").agg(first_row().alias("b")), "candidates")
        old = self.rows().select(F.col("digest").alias("known"), indexed_row().alias("i"))
        met = F.col("digest") == F.col("known")
        fresh = best.join(old.hint("merge"), met & (F.col("i") <= F.col("b")) if better else met, "left_anti")
        fresh = fresh.select("digest", F.col("b.doc_id").alias("keep_id"), F.col("b.__row").alias("keep_row"), (-F.col("b.n")).alias("chars"), F.lit(batch).alias("first_batch"))
        # one writer task per bucket, so a batch adds one sorted file to each bucket
        fresh.repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        unstage(self.spark, best)

    def best(self) -> DataFrame:
        """digest, b (the row that stays), of all batches; buckets are grouped where they lie."""
        return self.rows().groupBy("digest").agg(F.min(indexed_row()).alias("b"))

    def close(self) -> None:
        """Forget the table in this session's catalog; the folder keeps the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def drop(self) -> None:
        self.close()
        remove(self.spark, self.folder)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, __row, SHA-256 of the text without white space (32 bytes) and the text's code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hex64 = F.sha2(F.regexp_replace(text, f"{SPACE_CLASS}+", "").cast("binary"), 256)
    return docs.select("doc_id", "__row", F.unhex(hex64).alias("digest"), F.char_length(text).alias("chars"))


def exact_dedup(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, retry: bool = False) -> DataFrame:
    """One row per document: doc_id, __row, keep_id, group_size, kept, text_sha256, known (its text was in the index before this batch). With an index each
    batch has a name of its own; retry: the batch has been begun before, and is decided as it was. Without an index the table is one batch, against an empty index that is removed again."""
    return decide(spark, numbered(docs, "doc_id", "text"), index, batch, retry)


def decide(spark: SparkSession, rows: DataFrame, index: DigestIndex | None = None, batch: str | None = None, retry: bool = False) -> DataFrame:
    """exact_dedup of rows that have their numbers."""
    if index is not None and not batch:
        raise ValueError("a batch that goes into an index needs a name")
    own, batch = index or temporary(spark), batch or "whole"
    found = stage(spark, digests(rows), "digests")
    own.ingest(found, batch, retry)
    # the row that stays is named by this run's numbers: those in the index may be of an earlier run of the batch
    sizes = found.groupBy("digest").agg(F.count("*").alias("group_size"), first_row().getField("__row").alias("first_row"))
    # written, so that the join after it shuffles both sides afresh and a large group of copies is split among tasks
    groups = stage(spark, sizes.join(own.rows().hint("merge"), "digest"), "groups")
    if index is None:
        own.drop()
    known = F.col("first_batch") != batch
    return found.join(groups, "digest").select(
        "doc_id", "__row", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (~known & (F.col("__row") == F.col("first_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), known.alias("known"),
    )


def temporary(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")


def dedup_in_batches(spark: SparkSession, docs: DataFrame, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, __row, keep_id, group_size, kept, text_sha256, of all documents, which go into a new index batch by batch (dealt by a hash of the row): a batch is anti-joined to what the
    batches before it have left there, so copies of other batches go at the merge; rows that go before those of the index are appended, and the best of each digest stays in the end."""
    own = temporary(spark)
    try:
        found = stage(spark, digests(numbered(docs, "doc_id", "text")).withColumn("batch", F.pmod(F.xxhash64("__row"), F.lit(batches))), "digests")
        for k in range(batches):
            own.ingest(found.filter(F.col("batch") == k), str(k), better=True)
        sizes = found.groupBy("digest").agg(F.count("*").alias("group_size"))
        # written, so that the join after it shuffles both sides afresh and a large group of copies is split among tasks
        groups = stage(spark, sizes.join(own.best().hint("merge"), "digest"), "groups")
    finally:
        own.drop()
    return found.join(groups, "digest").select("doc_id", "__row", F.col("b.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("__row") == F.col("b.__row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, retry: bool = False) -> DataFrame:
    """The rows of docs, all columns, of which exact_dedup keeps one per group."""
    rows = stage_whole(spark, docs)
    kept = decide(spark, rows.select("doc.doc_id", "doc.text", "__row"), index, batch, retry).filter("kept").select("__row")
    return opened(rows.join(kept, "__row", "left_semi"))
