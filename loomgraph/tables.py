"""Intermediate tables in the folder that all executors see."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that all executors see. Only a local master may do without that setting; it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"spark.checkpoint.dir is not set: on {master}, intermediate tables need a folder that all executors see")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="loomgraph-"))
    return f"file://{_own_dir[0]}"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are removed when the write is done, since the written table takes the place of its lineage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(spark: SparkSession, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there, so lost executors cost no recomputation of earlier steps."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unstage(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(spark, path)


def unstage_read(spark: SparkSession, df: DataFrame) -> None:
    """Delete all staged tables that a result is read from, once it is written elsewhere; files outside the shared folder stay."""
    own = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath().rstrip("/") + "/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().startswith(own):
            remove(spark, path)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if there is none at that path, and say whether this call has made it. It is written under a hidden name and then given the path, which never replaces
    a file, so of several writers one gets the path and nobody sees half a file. On the driver's own disks that is a hard link; elsewhere a rename, so the store must refuse
    to rename onto a file, as HDFS does (object stores that replace it need a commit service instead)."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    hidden = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    if store.getScheme() == "file":
        own, final = hidden.toUri().getPath(), where.toUri().getPath()
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(own, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, final)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    out = store.create(hidden, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if store.exists(where) or not store.rename(hidden, where):
        store.delete(hidden, False)
        return False
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's files, in order; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(where) if f.isFile()) if store.exists(where) else []


def folders(spark: SparkSession, folder: str, holding: str) -> list[str]:
    """The names of the folders inside that hold a file of this name; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    at = where(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    inside = [f.getPath() for f in store.listStatus(at) if f.isDirectory()] if store.exists(at) else []
    return sorted(p.getName() for p in inside if store.exists(where(p, holding)))
