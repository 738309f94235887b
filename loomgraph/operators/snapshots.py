"""Snapshots: writing, promoting, comparing and telling their history."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.tables import create, names, stage


def fingerprint_flat(manifest: DataFrame) -> DataFrame:
    """One digest of a small manifest (path, sha256): digests of digests by the first byte of the path's hash, 256 groups at any size. fingerprint() is for manifests of any size."""
    item = F.sha2(F.concat_ws(":", "path", "sha256"), 256)
    groups = manifest.select(F.substring(F.sha2("path", 256), 1, 2).alias("g"), item.alias("i")).groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("i")), ""), 256).alias("d"), F.count("*").alias("n"))
    return groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("g", "d"))), ""), 256).alias("fingerprint"), F.sum("n").alias("files"))


#: How many digits of the path's hash name a group, level by level; each level folds at most 256 groups of the one below.
LEVELS = (6, 4, 2)


def fingerprint(manifest: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """One digest of a manifest of any size: groups of files, then groups of groups. With 16 million lowest groups, one holds about 1 000 of 10^10 files."""
    item = F.sha2(F.concat_ws(":", "path", "sha256"), 256)
    at = manifest.select(F.sha2("path", 256).alias("g"), item.alias("d"), F.lit(1).cast("bigint").alias("n"))
    fold = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), ""), 256).alias("d")
    for k, digits in enumerate(levels):
        own = F.concat("g", "d") if k else F.col("d")
        at = at.groupBy(F.substring("g", 1, digits).alias("g")).agg(fold(own), F.sum("n").alias("n"))
    return at.agg(fold(F.concat("g", "d")).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def snapshot_id(created_at: Column, fingerprint_: Column) -> Column:
    """UTC stamp and the first digits of the fingerprint."""
    return F.concat(F.date_format(created_at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(fingerprint_, 1, 12))


def freshness(analyzer: Column, companion: Column, fingerprint_: Column, now_analyzer: Column, now_companion: Column, now_fingerprint: Column) -> Column:
    """Of a snapshot against the present: stale if a version or the source differs, unknown if the source was not looked at, partial without a snapshot."""
    same = F.coalesce((analyzer == now_analyzer) & (companion == now_companion), F.lit(False))
    return F.when(fingerprint_.isNull(), "partial").when(~same, "stale").when(now_fingerprint.isNull(), "unknown").when(fingerprint_ == now_fingerprint, "current").otherwise("stale")


def unchanged(analyzer: Column, companion: Column, fingerprint_: Column, now_analyzer: Column, now_companion: Column, now_fingerprint: Column) -> Column:
    """Whether a new snapshot would be the same as the present one."""
    return F.coalesce((fingerprint_ == now_fingerprint) & (analyzer == now_analyzer) & (companion == now_companion), F.lit(False))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


PROMOTIONS = "snapshot_id string, fingerprint string, promoted_at timestamp, trigger string, nodes bigint, edges bigint, after string, run string"


class Conflict(ValueError):
    """Another writer has promoted a snapshot since this one began."""


def _entry(number: int) -> str:
    return f"{number:012d}.json"


def head(spark: SparkSession, root: str) -> int:
    """The number of the last promotion; 0 before the first."""
    found = [n for n in names(spark, f"{root}/promotions") if n.endswith(".json") and n[:12].isdigit()]
    return int(found[-1][:12]) if found else 0


def publish(
    spark: SparkSession, root: str, snapshot: str, nodes: DataFrame, edges: DataFrame, fingerprint_: str = "", fingerprint_now: Callable[[], str] | None = None, trigger: str = "manual", base: int | None = None,
) -> str:
    """Tables first, the pointer last: a failed run leaves the current snapshot as it was, and running it again writes its tables anew. Returns the snapshot's id: a name that a
    promoted snapshot has gets a suffix, so what is promoted stays as it is. fingerprint_now is asked again before the pointer is written, and must not have changed.

    The pointer is the last of numbered entries, each made only if its number is free. base is the number that the writer began from (head(), by default as it is on entry): if another writer has
    promoted since, this one gets a Conflict, nothing of it is seen, and it may begin again from the new head."""
    base = head(spark, root) if base is None else base
    promoted = base > 0 and not history(spark, root, None).filter(F.col("snapshot_id") == snapshot).isEmpty()
    if promoted:
        snapshot = f"{snapshot}-{uuid.uuid4().hex[:8]}"
    # writers that began at the same head have tables of their own until one of them is promoted
    run = uuid.uuid4().hex
    counts = []
    for name, table in (("nodes", nodes), ("edges", edges)):
        path = f"{root}/{name}/snapshot_id={snapshot}/run={run}"
        table.write.parquet(path)
        counts.append(spark.read.schema(table.schema).parquet(path).count())
    if fingerprint_now and fingerprint_now() != fingerprint_:
        raise ValueError("the source has changed while it was read")
    before = "" if not base else json.loads(_text(spark, f"{root}/promotions/{_entry(base)}"))["snapshot_id"]
    at = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("t")).first()["t"]
    row = {"snapshot_id": snapshot, "fingerprint": fingerprint_, "promoted_at": at, "trigger": trigger, "nodes": counts[0], "edges": counts[1], "after": before, "run": run}
    if not create(spark, f"{root}/promotions/{_entry(base + 1)}", json.dumps(row) + "\n"):
        raise Conflict(f"another snapshot was promoted after number {base}")
    return snapshot


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def history(spark: SparkSession, root: str, most: int | None = 20) -> DataFrame:
    """Promoted snapshots, the latest first."""
    return history_page(spark.read.schema(PROMOTIONS).json(f"{root}/promotions"), "snapshot_id", "promoted_at", most)


def history_page(snapshots: DataFrame, ident: str, at: str, most: int | None = 20) -> DataFrame:
    """The latest snapshots that are valid (they have an id and a time), each with the one before it, and whether the bound was reached."""
    valid = snapshots.filter(F.col(ident).isNotNull() & F.col(at).isNotNull()).orderBy(F.desc(at), F.desc(ident))
    if most is None:
        return valid
    # one row more than asked for, to name the last one's predecessor; so few rows that one task sorts them
    few = valid.limit(most + 1)
    w = Window.orderBy(F.desc(at), F.desc(ident))
    few = few.select("*", F.lead(ident).over(w).alias("previous"), F.row_number().over(w).alias("position"))
    return few.filter(F.col("position") <= most).withColumn("truncated", F.count("*").over(Window.partitionBy()) >= most)


def alias(spark: SparkSession, root: str, name: str) -> str:
    """current, previous or the id itself."""
    if name not in ("current", "previous"):
        return name
    rows = history(spark, root, 2).collect()
    k = ("current", "previous").index(name)
    if k >= len(rows):
        raise ValueError(f"no snapshot is {name}")
    return rows[k]["snapshot_id"]


def load(spark: SparkSession, root: str, name: str = "current") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a promoted snapshot, by alias or id."""
    ident = alias(spark, root, name)
    found = history(spark, root, None).filter(F.col("snapshot_id") == ident).first()
    if not found:
        raise ValueError(f"snapshot {ident} is not promoted")
    nodes, edges = (spark.read.parquet(f"{root}/{x}/snapshot_id={ident}/run={found['run']}") for x in ("nodes", "edges"))
    for table, needed in ((nodes, {"id"}), (edges, {"source", "target", "type"})):
        if missing := needed - set(table.columns):
            raise ValueError(f"snapshot {ident} lacks {sorted(missing)}")
    return nodes, edges


def workspaces(spark: SparkSession, registry: DataFrame, most: int = 1000) -> DataFrame:
    """The latest entry (id, label, root, seq) of each workspace, by label and id, with whether its folder is there. A registry is a short list: at most so many entries."""
    latest = registry.groupBy("id").agg(F.max_by(F.struct("label", "root"), "seq").alias("x")).select("id", "x.*").orderBy(F.lower("label"), "id").limit(most)
    rows = [(r["id"], r["label"], r["root"], "available" if exists(spark, r["root"]) else "stale") for r in latest.collect()]
    return spark.createDataFrame(rows, "id string, label string, root string, status string")


def sides(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str] = ()) -> DataFrame:
    """keys, sides (1: before only, 2: after only, 3: both), and what the fields were and are: both tables as one, grouped once by key, so each side is read once. Null keys are equal."""
    some = lambda df, k: df.select(*keys, F.lit(k).alias("side"), F.struct(F.lit(0).alias("_"), *fields).alias("x"))
    one = lambda k, name: F.max(F.when(F.col("side") == k, F.col("x"))).alias(name)
    return some(before, 1).unionByName(some(after, 2)).groupBy(*keys).agg(F.bit_or("side").alias("sides"), *([one(1, "was"), one(2, "now")] if fields else []))


def diff_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key that only one side has."""
    return sides(before, after, keys).filter("sides < 3").select(*keys, F.when(F.col("sides") == 2, "added").otherwise("removed").alias("change"))


def diff_modified(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys on both sides of which a field differs; null equals null."""
    return sides(before, after, [key], fields).filter((F.col("sides") == 3) & ~F.col("was").eqNullSafe(F.col("now"))).select(key)


def diff(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], fields: list[str], most: int = 100) -> DataFrame:
    """Two snapshots (nodes, edges) as one table: section (nodesAdded, nodesRemoved, nodesModified, edgesAdded, edgesRemoved), position, key (id, or source, target and type
    separated by spaces), how many there are in the section, and whether any section was cut. Sections keep their first rows by key; an empty one has a row without a key.
    Nodes are grouped once and edges once; what differs is written, and counts and pages are read from there."""
    spark = before[0].sparkSession
    parts = []
    for name, cols, own, k in (("nodes", ["id"], fields, 0), ("edges", ["source", "target", "type"], [], 1)):
        found = sides(before[k], after[k], cols, own)
        section = F.when(F.col("sides") == 2, f"{name}Added").when(F.col("sides") == 1, f"{name}Removed")
        section = section.when(~F.col("was").eqNullSafe(F.col("now")), f"{name}Modified") if own else section
        parts.append(found.select(section.alias("section"), F.concat_ws(" ", *cols).alias("key")).filter("section is not null"))
    rows = stage(spark, parts[0].unionByName(parts[1]), "differences")
    counts = rows.groupBy("section").agg(F.count("*").alias("n"))
    position = F.row_number().over(Window.partitionBy("section").orderBy("key"))
    shown = rows.withColumn("position", position).filter(F.col("position") <= most)
    sections = spark.createDataFrame([(s,) for s in ("nodesAdded", "nodesRemoved", "nodesModified", "edgesAdded", "edgesRemoved")], "section string")
    counts = sections.join(counts, "section", "left").select("section", F.coalesce("n", F.lit(0)).alias("n"), (F.max("n").over(Window.partitionBy()) > most).alias("truncated"))
    return counts.join(shown, "section", "left").select("section", "position", "key", "n", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def change_basis(fp_a: Column, fp_b: Column, analyzer_a: Column, analyzer_b: Column, companion_a: Column, companion_b: Column) -> Column:
    """Why two snapshots differ."""
    known = (F.coalesce(analyzer_a, F.lit("")) != "") & (F.coalesce(analyzer_b, F.lit("")) != "") & (F.coalesce(companion_a, F.lit("")) != "") & (F.coalesce(companion_b, F.lit("")) != "")
    return (
        F.when(fp_a.isNull() | fp_b.isNull(), "legacy_unknown")
        .when((fp_a != fp_b) & known & ((analyzer_a != analyzer_b) | (companion_a != companion_b)), "mixed").when(fp_a != fp_b, "source_change")
        .when(~known, "legacy_unknown").when(analyzer_a != analyzer_b, "analyzer_reinterpretation").when(companion_a != companion_b, "analysis_refresh").otherwise("no_change")
    )
