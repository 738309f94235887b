"""Candidates, relations, batches and merged suggestions for an external scorer, which stays pluggable."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.folds import SEGMENT_BITS, segmented
from loomgraph.schemas import CANDIDATE_RELATIONS, CODE_TYPES, MOST_CANDIDATES, MOST_PER_REQUEST, MOST_RELATIONS, MOST_REQUEST_BYTES, ROLE_TOKENS


def top_relations(edges: DataFrame, most: int = MOST_RELATIONS) -> DataFrame:
    """Each source's first distinct relations by type and target."""
    k = F.row_number().over(Window.partitionBy("source").orderBy("type", "target"))
    return edges.select("source", "type", "target").distinct().withColumn("k", k).filter(F.col("k") <= most)


def first_candidates(items: DataFrame, group: str, key: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """Each group's first `most` items by key: the bound of candidate selection, not of batching."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return items.withColumn("k", k).filter(F.col("k") <= most).drop("k")


def _opens(n: int, used: int, size: int) -> bool:
    """Whether a new batch begins with a row of this size."""
    return n >= MOST_PER_REQUEST or (n > 0 and used + size > MOST_REQUEST_BYTES)


def _batch_from(sizes: list[int], at: int) -> tuple[int, int, int]:
    """Where the batch that begins with this row ends (or the segment does), with its rows and bytes until then."""
    n = used = 0
    while at < len(sizes) and not _opens(n, used, sizes[at]):
        n, used, at = n + 1, used + sizes[at], at + 1
    return at, n, used


def _batch_summary(rows: list[tuple]) -> dict:
    """The first sizes of a segment, and for each of the places where its first batch can begin, how many begin and what is open at the end. The batch that is open
    before a segment ends within its first MOST_PER_REQUEST rows, so there are few such places."""
    sizes = [x for _, x in rows]
    behind: list[tuple] = [(0, 0, 0)] * len(sizes)
    for at in range(len(sizes) - 1, -1, -1):
        stop, n, used = _batch_from(sizes, at)
        more = behind[stop] if stop < len(sizes) else (0, n, used)
        behind[at] = (1 + more[0], *more[1:])
    return {"sizes": sizes[: MOST_PER_REQUEST + 1], "behind": behind[: MOST_PER_REQUEST + 1]}


def _batch_behind(state: list, done: dict) -> list:
    batch, n, used = state
    for size, (begun, n_open, used_open) in zip(done["sizes"], done["behind"]):
        if _opens(n, used, size):
            return [batch + begun, n_open, used_open]
        n, used = n + 1, used + size
    return [batch, n, used]


def _batch_rows(state: list, rows: list[tuple]) -> Iterator[tuple]:
    batch, n, used = state
    for key, size in rows:
        if _opens(n, used, size):
            batch, n, used = batch + 1, 0, 0
        n, used = n + 1, used + size
        yield key, batch


def greedy_batches(items: DataFrame, group: str, key: str, size: str, bits: int = SEGMENT_BITS) -> DataFrame:
    """Batches of all items of each group by key: a new one begins when count or bytes would overflow. A group's sorted rows are cut freely into segments; what a segment does to
    the batch that is open before it is summed up, and segments are replayed from there, so the batches are those of one pass, however large a group is. A null size counts as 0. Rows
    that are equal in group and key are batched one by one."""
    rows = items.select(F.col(group), F.col(key), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__size"))
    kind = items.schema[key].dataType.simpleString()
    return segmented(items.sparkSession, rows, group, [key, "__size"], [key, "__size"], _batch_summary, _batch_behind, _batch_rows, f"{key} {kind}, batch int", start=[0, 0, 0], bits=bits)


def candidates(nodes: DataFrame, edges: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """Code nodes without a pipeline role of their own and with a portable id, name and qualified name: the first by id."""
    named = portable_text("id", 1000) & portable_text("name", 300) & portable_text("qualified_name", 500)
    roles = edges.filter("type = 'HAS_PIPELINE_ROLE'").select(F.col("source").alias("id"))
    return nodes.filter(F.col("type").isin(CODE_TYPES) & named).join(roles, "id", "left_anti").orderBy("id").limit(most)


def portable_text(name: str, most: int) -> Column:
    x = F.col(name)
    return F.coalesce((x != "") & (F.char_length(x) <= most) & ~x.rlike(r"[\p{Cc}\p{Cf}\p{Cs}]"), F.lit(False))


def candidate_relations(found: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = MOST_RELATIONS) -> DataFrame:
    """Of each candidate the first distinct relations of the types that may be told, by type and the target's qualified name and name. At most MOST_CANDIDATES candidates, so they are sent to
    all tasks; targets are joined to what is left."""
    own = F.broadcast(found.select(F.col("id").alias("source")))
    edges = edges.filter(F.col("type").isin(CANDIDATE_RELATIONS)).select("source", "target", "type").join(own, "source", "left_semi")
    clean = lambda c, n: F.when(portable_text(c, n), F.col(c)).otherwise("")
    ends = nodes.filter(portable_text("id", 1000)).select(F.col("id").alias("target"), clean("type", 80).alias("target_type"), clean("name", 300).alias("target_name"), clean("qualified_name", 500).alias("target_qualified_name"))
    rows = edges.join(ends, "target").select("source", "type", "target_type", "target_name", "target_qualified_name").distinct()
    k = F.row_number().over(Window.partitionBy("source").orderBy("type", "target_qualified_name", "target_name", "target_type"))
    return rows.withColumn("k", k).filter(F.col("k") <= most)


def unknown_suggestions(found: DataFrame, candidates_: DataFrame, node: str) -> DataFrame:
    """Suggestions for nodes that nobody asked about; there must be none."""
    return found.join(candidates_.select(F.col("id").alias(node)), node, "left_anti")


def suggestion_counters(found: DataFrame, node: str, role: str, order: str) -> DataFrame:
    """One row: suggestions left out for an unsupported role, as duplicates, and for a conflict. A node's suggestions count in order: equal to the first, a duplicate;
    the first that differs takes the kept one with it, and all after it are conflicts as well."""
    supported = found.filter(F.col(role).isin(list(ROLE_TOKENS)))
    w = Window.partitionBy(node).orderBy(order)
    rows = supported.select(node, F.row_number().over(w).alias("k"), (F.col(role) != F.first(role).over(w)).alias("other"))
    per = rows.groupBy(node).agg(F.count("*").alias("n"), F.min(F.when(F.col("other"), F.col("k"))).alias("m"))
    same, split = F.coalesce(F.col("m") - 2, F.col("n") - 1), F.when(F.col("m").isNotNull(), 2 + F.col("n") - F.col("m")).otherwise(0)
    sums = per.agg(F.coalesce(F.sum(same), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(split), F.lit(0)).alias("conflicting"))
    odd = found.agg(F.count_if(F.coalesce(~F.col(role).isin(list(ROLE_TOKENS)), F.lit(True))).alias("unsupported"))
    tagged = sums.select("duplicates", "conflicting", F.lit(None).cast("bigint").alias("unsupported")).unionByName(odd, True)  # two rows, of which each column is in one
    return tagged.agg(*[F.max(c).cast("bigint").alias(c) for c in ("unsupported", "duplicates", "conflicting")])


def merge_suggestions(found: DataFrame, node: str, role: str, confidence: str) -> DataFrame:
    """One role per node with the least confidence; nodes with conflicting roles are quarantined."""
    merged = found.groupBy(node).agg(F.min(role).alias("role"), F.max(role).alias("other"), F.min(confidence).alias("confidence"), F.count("*").alias("n"))
    return merged.filter("role = other").drop("other")
