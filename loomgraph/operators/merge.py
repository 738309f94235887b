"""Merging and reconciling what extraction found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.schemas import MOST_EVIDENCE


def dedup_edges(edges: DataFrame) -> DataFrame:
    """An edge is its (source, target, type); self-loops are no edges."""
    return edges.filter("source <> target").groupBy("source", "target", "type").agg(F.count("*").alias("n"))


def bounded_evidence(items: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """The smallest distinct canonical items of each edge. Distinct items are reduced before the edges' lists are made, so a list stays short however often an item occurs."""
    distinct = items.groupBy("source", "target", "type", "canon").agg(F.count("*").alias("seen"))
    kept = F.row_number().over(Window.partitionBy("source", "target", "type").orderBy("canon"))
    return distinct.withColumn("k", kept).filter(F.col("k") <= most).groupBy("source", "target", "type").agg(F.array_sort(F.collect_list("canon")).alias("evidence"))


def merge_nodes(found: DataFrame, ordinal: str, fields: list[str]) -> DataFrame:
    """For each id the first non-empty value of each field in arrival order; of the type, the first that isn't External*."""
    first = lambda name, ok: F.min_by(F.when(ok, F.col(name)), F.when(ok, F.col(ordinal)))
    internal = first("type", ~F.col("type").startswith("External"))
    return found.groupBy("id").agg(F.coalesce(internal, first("type", F.col("type").isNotNull())).alias("type"), *[first(x, F.col(x).isNotNull() & (F.col(x) != "")).alias(x) for x in fields])


def redirects(placeholders: DataFrame, internal: DataFrame) -> DataFrame:
    """placeholder id -> internal id, by (language, qualified name; the last internal of a name wins), else by a simple name that only one has. With a type column,
    only Java's external types fall back on the simple name."""
    exact = internal.groupBy("language", "qualified_name").agg(F.max_by("id", "ordinal").alias("by_name"))
    simple = internal.groupBy("name").agg(F.min("id").alias("by_simple"), F.count("*").alias("n")).filter("n = 1").drop("n")
    joined = placeholders.join(exact, ["language", "qualified_name"], "left").join(simple, "name", "left")
    bare = ~F.col("qualified_name").contains(".")
    if "type" in placeholders.columns:
        bare &= (F.col("language") == "Java") & (F.col("type") == "ExternalType")
    return joined.select("id", F.coalesce("by_name", F.when(bare, F.col("by_simple"))).alias("to")).filter("to is not null")


def rewrite_edges(edges: DataFrame, redirect: DataFrame) -> DataFrame:
    """Ends at placeholders move to what they stand for; loops that arise go, equal edges become one."""
    a, b = redirect.select(F.col("id").alias("source"), F.col("to").alias("s_to")), redirect.select(F.col("id").alias("target"), F.col("to").alias("t_to"))
    moved = edges.join(a, "source", "left").join(b, "target", "left")
    return dedup_edges(moved.select(F.coalesce("s_to", "source").alias("source"), F.coalesce("t_to", "target").alias("target"), "type"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    rows = old.unionByName(new)
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("x")).select(key, "x.*")


def unique_target(calls: DataFrame, declared: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Calls whose key names exactly one declared target."""
    one = declared.groupBy(*keys).agg(F.min(target).alias("target"), F.max(target).alias("other")).filter("target = other").drop("other")
    return calls.join(one, keys)


def spread(scopes: DataFrame, begin: Column, end: Column, bucket: Callable[[Column], Column], name: str = "bucket") -> DataFrame:
    """Scopes, once for each bucket of places that they reach into."""
    return scopes.withColumn(name, F.explode(F.sequence(bucket(begin), F.greatest(bucket(begin), bucket(end)))))


def outside(positions: DataFrame, spans: DataFrame, key: str, at: Column, begin: Column, end: Column, bucket: Callable[[Column], Column] = lambda x: F.lit(0)) -> DataFrame:
    """Positions that lie strictly inside no span of their key, bucket by bucket."""
    own = spread(spans, begin, end, bucket, "span_bucket").withColumnRenamed(key, "span_key")
    inside = (F.col("span_key") == F.col(key)) & (F.col("span_bucket") == F.col("bucket")) & (begin < at) & (at < end)
    return positions.withColumn("bucket", bucket(at)).join(own, inside, "left_anti").drop("bucket")


def resolved_types(uses: DataFrame, files: DataFrame, imports: DataFrame, wildcards: DataFrame, declared: DataFrame, accepted: DataFrame) -> DataFrame:
    """repo, file, name, qualified, known: what simple type names mean. uses: repo, file, name; files: repo, file, package, failed; imports: repo, file, name, target; wildcards: repo, file, package; declared:
    repo, package, name; accepted: name, qualified (the types that count as known).

    An import of the name decides. Else the one package that the file imports as a whole does, if it has an accepted type of that name, unless a type of that name is declared in the file's own package, which goes before.
    If any file of a repository could not be read, nobody knows what it declares, so no name of that repository is taken from a wildcard (bool_or over
    its files). What is left is a type of the file's own package.

    Uses are read once and meet all of that in left joins. Keys that few values have (repository; name and accepted type) are not dealt by: a row for each repository and the list of accepted types are
    sent to all tasks. Declarations are made distinct before they are joined."""
    own = files.groupBy("repo", "file").agg(F.min("package").alias("package"))
    readable = files.groupBy("repo").agg(F.bool_or("failed").alias("off")).filter("not coalesce(off, false)").select("repo", F.lit(True).alias("readable"))
    named = imports.groupBy("repo", "file", "name").agg(F.min("target").alias("target"))
    one = wildcards.groupBy("repo", "file").agg(F.min("package").alias("wild"), F.max("package").alias("other")).filter("wild = other").drop("other")
    known = accepted.select("name", "qualified").distinct()
    declares = declared.select("repo", "package", "name").distinct().withColumn("declares", F.lit(True))
    taken = known.select("name", F.col("qualified").alias("candidate"), F.lit(True).alias("accepted"))
    exact = known.select("name", F.col("qualified").alias("target"), F.lit(True).alias("listed"))
    per_file = own.join(one, ["repo", "file"], "full")
    asked = uses.select("repo", "file", "name").distinct().join(named, ["repo", "file", "name"], "left").join(per_file, ["repo", "file"], "left")
    asked = asked.join(F.broadcast(readable), "repo", "left").withColumn("candidate", F.when(F.col("target").isNull() & F.col("readable"), F.concat_ws(".", "wild", "name")))
    asked = asked.join(F.broadcast(taken), ["name", "candidate"], "left").join(declares, ["repo", "package", "name"], "left").join(F.broadcast(exact), ["name", "target"], "left")
    by_wildcard = F.when(F.col("accepted") & F.col("wild").isNotNull() & F.col("declares").isNull(), F.col("candidate"))
    qualified = F.coalesce("target", by_wildcard, F.when(F.col("package") != "", F.concat_ws(".", "package", "name")), F.col("name"))
    return asked.select("repo", "file", "name", qualified.alias("qualified"), (by_wildcard.isNotNull() | F.coalesce("listed", F.lit(False))).alias("known"))
