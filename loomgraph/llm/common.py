"""What the training-data operators share: words, Arrow helpers and shared staging."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.tables import create, remove, shared_dir, stage, tidy, unstage  # noqa: F401

#: The white space of every contract: the six ASCII white-space characters. bytes.split() splits at exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


@contextlib.contextmanager
def bucketed(spark: SparkSession, rows: DataFrame, buckets: int, column: str, name: str, codec: str = "zstd") -> Iterator[DataFrame]:
    """The rows as a table bucketed and sorted by a column, in the shared folder; table and files go at the end, also where what is done with it fails."""
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    try:
        with tidy(spark):
            rows.write.format("parquet").option("compression", codec).option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(table)
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands at most so many rows at once to Python: for rows of many kilobytes, whose batches would else hold 10 000 of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def numbered(df: DataFrame, *columns: str) -> DataFrame:
    """These columns and a row number __row: repeated rows and null ids stay apart. It holds for one read only, as a second may cut the files otherwise."""
    return df.select(*columns, F.monotonically_increasing_id().alias("__row"))


def stage_numbered(spark: SparkSession, df: DataFrame, *columns: str, codec: str | None = None) -> DataFrame:
    """The columns with their row numbers, written once, for all that reads them more than once."""
    return stage(spark, numbered(df, *columns), "numbered", codec)


def stage_whole(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows (doc, __row), written once: doc is a struct of all columns of df, so none of their names can clash with those that an operator adds.
    Its fields are read one by one (doc.text), and opened() gives the columns back."""
    return stage(spark, df.select(F.struct(*[F.col(f"`{x}`") for x in df.columns]).alias("doc"), F.monotonically_increasing_id().alias("__row")), "numbered", "zstd")


def opened(rows: DataFrame) -> DataFrame:
    """The columns of the table that stage_whole() was given."""
    return rows.select("doc.*")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches to slices of about most_bytes (one row at least), so that memory in Python is bounded by the longest row."""
    for batch in batches:
        begin, size = 0, 0
        step = batch.schema.get_field_index("text")
        lengths = pc.binary_length(batch.column(step)).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n or 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


class Memo(dict):
    """A dict that makes missing values one by one; trim() empties it once it is larger than most, so memory stays bounded."""

    def __init__(self, make: Callable, most: int = 400_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
