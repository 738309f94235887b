"""Watching a folder of documents: new files as a stream, everything that has changed since the last look, by digest, or changes of a stream of sightings, with one state per path."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.tables import folders, remove

STATE = "path string, sha256 string, look bigint"
#: Looks that are kept beside the last whole state before a new one is written.
MOST_LOOKS = 16


def watch(spark: SparkSession, folder: str, checkpoint: str, on_change: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Call on_change with path and sha256 of files that have appeared, batch by batch, until all present files are processed. Spark's file stream knows files by
    their path: one that is written anew under its old name is not seen again (poll sees it). Batches are replayed after a failure, so on_change must be idempotent."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(folder)
    found = files.select("path", F.sha2("content", 256).alias("sha256"))
    return found.writeStream.foreachBatch(on_change).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _kept(spark: SparkSession, states: str) -> tuple[int, list[int]]:
    """The number of the last whole state (0: there is none), and those of the looks after it. Folders without a mark of success are of a writer that died."""
    found = {n: int(n.split("=")[1]) for n in folders(spark, states, "_SUCCESS") if n.startswith(("whole=", "look="))}
    whole = max((k for n, k in found.items() if n.startswith("whole=")), default=0)
    return whole, sorted(k for n, k in found.items() if n.startswith("look=") and k > whole)


def state(spark: SparkSession, states: str) -> DataFrame:
    """path, sha256 of the files as they were at the last look: the last whole state and what the looks after it changed, in order of their numbers."""
    whole, looks = _kept(spark, states)
    paths = [f"{states}/whole={whole}"] * bool(whole) + [f"{states}/look={k}" for k in looks]
    if not paths:
        return spark.createDataFrame([], "path string, sha256 string")
    latest = spark.read.schema(STATE).parquet(*paths).groupBy("path").agg(F.max_by(F.struct("sha256"), "look").alias("x"))
    return latest.select("path", "x.sha256").filter("sha256 is not null")


def poll(spark: SparkSession, folder: str, states: str, on_change: Callable[[DataFrame], None]) -> None:
    """One look: on_change gets path, sha256 and change (added, changed, removed) of what differs from the state; then the state takes it over. If it fails before that, the next look
    finds the same changes again, so on_change must be idempotent. Looks are numbered; after MOST_LOOKS of them the state is written as a whole and they are removed, so a look reads a
    bounded number of folders. One watcher at a time uses a folder of states."""
    whole, looks = _kept(spark, states)
    number = max([whole, *looks]) + 1
    old = state(spark, states).withColumnRenamed("sha256", "old")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("sha256"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("sha256").isNull(), "removed").otherwise("changed")
    found = files.join(old, "path", "full").filter(~F.col("sha256").eqNullSafe(F.col("old"))).select("path", "sha256", change.alias("change"))
    # written first, so that on_change and the state see the same look
    pending = f"{states}/pending={number}"
    found.withColumn("look", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(pending)
    written = spark.read.schema(f"{STATE}, change string").parquet(pending)
    on_change(written.select("path", "sha256", "change"))
    written.select("path", "sha256", "look").write.mode("overwrite").parquet(f"{states}/look={number}")
    remove(spark, pending)
    if len(looks) + 1 >= MOST_LOOKS:
        state(spark, states).withColumn("look", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{states}/whole={number}")
        for old_one in [f"{states}/look={k}" for k in [*looks, number]] + [f"{states}/whole={whole}"] * bool(whole):
            remove(spark, old_one)


CHANGES = "path string, sha256 string, change string, seen timestamp"


def follow(sightings: DataFrame, gone_after: str = "1 hour") -> DataFrame:
    """Changes (CHANGES: added, changed, removed) of a stream of sightings (path, sha256, seen). The state store keeps the last digest and sighting of each path, and drops it when
    the path has not been seen for gone_after in event time, which is a removal; so the state holds the present files, however long the stream runs. Sightings that are
    older than the watermark are left out; those of one batch count in the order of their time, so a replayed batch gives the same changes. For writeStream in append mode."""
    late = int(pd.Timedelta(gone_after).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        path, out = key[0], []
        if kept.hasTimedOut:
            _, last = kept.get
            out.append((path, None, "removed", pd.Timestamp(last + late, unit="ms")))
            kept.remove()
        else:
            rows: list[Any] = sorted((t, d) for f in frames for t, d in zip(f["seen"], f["sha256"]))
            digest, last = kept.get if kept.exists else (None, 0)
            for seen, now in rows:
                at = int(seen.timestamp() * 1000)
                if at >= last and now != digest:
                    out.append((path, now, "added" if digest is None else "changed", seen))
                    digest = now
                last = max(last, at)
            kept.update((digest, last))
            kept.setTimeoutTimestamp(max(last + late, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "sha256", "change", "seen"]).astype({"seen": "datetime64[ns]"})

    return sightings.withWatermark("seen", "0 seconds").groupBy("path").applyInPandasWithState(step, CHANGES, "sha256 string, last bigint", "append", GroupStateTimeout.EventTimeTimeout)
