"""Search, neighbourhoods, degrees and owner trails on nodes and edges."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import flattened, search_text
from loomgraph.operators.nesting import chains
from loomgraph.schemas import LENSES, MOST_AMBIGUOUS, MOST_IMPACT, MOST_RESOLVED, MOST_SEARCH, MOST_SYMBOLS, PREFERRED, STRUCTURAL, TYPE_PRIORITY
from loomgraph.tables import remove, tidy

ADJACENT = "node string, next string, type string, direction string"


def priority(kind: Column) -> Column:
    return F.coalesce(F.create_map(*map(F.lit, chain(*TYPE_PRIORITY.items())))[kind], F.lit(20))


#: Metadata that is searched, and whether it is a list.
SEARCHED = {"return_type": False, "semantic_groups": True, "ordinal": False}


def full_text(nodes: DataFrame) -> Column:
    """The search text of all that a node has of id, type, name, language, path, qualified name and metadata."""
    own = [F.col(c) for c in ("id", "type", "name", "language", "path", "qualified_name") if c in nodes.columns]
    return search_text(*own, *([flattened(F.col("metadata"), SEARCHED)] if "metadata" in nodes.columns else []))


def search(nodes: DataFrame, term: str, most: int = MOST_SEARCH) -> DataFrame:
    """Nodes whose text holds the term, by name, then id. The sort keeps only the first rows of each task."""
    return nodes.filter(full_text(nodes).contains(term.lower())).orderBy(F.lower("name"), "id").limit(most)


def ranked_search(nodes: DataFrame, term: str, most: int = MOST_SEARCH, **facets: str) -> DataFrame:
    """Score 0 (the name) to 5 (somewhere in the text), then type priority, name and id."""
    needle = F.lit(term.strip().lower())
    name, ident = F.lower("name"), F.lower("id")
    qualified = F.lower("qualified_name") if "qualified_name" in nodes.columns else F.lit(None).cast("string")
    score = (
        F.when(name == needle, 0).when((ident == needle) | (F.coalesce(qualified, F.lit("")) == needle), 1).when(name.startswith(needle), 2)
        .when(qualified.startswith(needle), 3).when(ident.startswith(needle), 4).when(full_text(nodes).contains(needle), 5)
    )
    for column, value in facets.items():
        nodes = nodes.filter(F.col(column) == value)
    return nodes.withColumn("score", score).filter("score is not null").orderBy("score", priority(F.col("type")), name, "id").limit(most)


def lens_edges(edges: DataFrame, nodes: DataFrame, lens: str, root: str = "") -> DataFrame:
    """Edges that a lens shows; the architecture lens keeps declarations between structural nodes or at the root, the spring lens annotations of a Spring
    group only (if nodes have metadata)."""
    if LENSES[lens] is not None:
        edges = edges.filter(F.col("type").isin(LENSES[lens]))
    if lens == "architecture":
        # whether both ends of a declaration are structural, in one pass over the edges for each end
        s = nodes.filter(F.col("type").isin(STRUCTURAL)).select("id")
        end = lambda c: s.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_kept"))
        both = edges.join(end("source"), "source", "left").join(end("target"), "target", "left")
        rooted = F.col("source").eqNullSafe(root) | F.col("target").eqNullSafe(root)
        edges = both.filter((F.col("type") != "DECLARES") | rooted | (F.col("source_kept") & F.col("target_kept")))
    if lens == "spring" and "metadata" in nodes.columns:
        grouped = nodes.filter(F.size("metadata.semantic_groups") > 0).select(F.col("id").alias("target"))
        edges = edges.filter("type <> 'ANNOTATED_BY'").unionByName(edges.filter("type = 'ANNOTATED_BY'").join(grouped, "target", "left_semi"))
    return edges.select("source", "target", "type")


def adjacency(edges: DataFrame, directions: tuple[str, ...] = ("outgoing", "incoming")) -> DataFrame:
    """Each edge from both of its ends (or from one), in one pass over the edges."""
    way = lambda node, next_, direction: F.struct(F.col(node).alias("node"), F.col(next_).alias("next"), F.col("type"), F.lit(direction).alias("direction"))
    ends = {"outgoing": way("source", "target", "outgoing"), "incoming": way("target", "source", "incoming")}
    return edges.select(F.inline(F.array(*[ends[d] for d in directions])))


def resolve(nodes: DataFrame, symbols: list[str], text: Column) -> DataFrame:
    """symbol, status (ok, ambiguous, not_found), id, name, qualified_name, position. A symbol stands for the nodes that it names exactly (id, qualified name or name), else for
    those whose text holds it; only the first MOST_RESOLVED matches by name and id are looked at, and at most MOST_AMBIGUOUS candidates are given.
    symbols are at most MOST_SYMBOLS, so the nodes are read once and only matches are sorted."""
    if len(symbols) > MOST_SYMBOLS:
        raise ValueError(f"at most {MOST_SYMBOLS} symbols are resolved at once")
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    needle = F.lower("symbol")
    found = nodes.withColumn("text", text).join(F.broadcast(wanted), F.expr("contains(text, lower(symbol))"))
    order = F.row_number().over(Window.partitionBy("symbol").orderBy(F.lower("name"), "id"))
    exact = (F.lower("id") == needle) | (F.lower("qualified_name") == needle) | (F.lower("name") == needle)
    found = found.withColumn("k", order).filter(F.col("k") <= MOST_RESOLVED).select("symbol", "id", "name", "qualified_name", "k", F.coalesce(exact, F.lit(False)).alias("exact"))
    per = Window.partitionBy("symbol")
    found = found.withColumn("any", F.max("exact").over(per)).filter("exact or not any")
    found = found.withColumn("n", F.count("*").over(per)).withColumn("position", F.row_number().over(per.orderBy("k"))).filter(F.col("position") <= MOST_AMBIGUOUS)
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    return wanted.join(found, "symbol", "left").select("symbol", status.alias("status"), "id", "name", "qualified_name", "position")


def impact_of(spark: SparkSession, nodes: DataFrame, edges: DataFrame, symbol: str, text: Column, depth: int = 2, most: int = MOST_IMPACT) -> tuple[str, DataFrame]:
    """Status of a symbol, and its impact if it names one node, else its candidates (none if nothing is found)."""
    found = resolve(nodes, [symbol], text)
    first = found.orderBy("position").first()
    if first["status"] == "ok":
        return "ok", impact(spark, nodes, edges, first["id"], depth, most)
    return first["status"], found.filter("id is not null").select("id", "name", "qualified_name")


def presented(hops: DataFrame, most: int = MOST_IMPACT) -> DataFrame:
    """The rows of impact() with their position in the result, by depth, name and discovery, and whether the bound was reached. At most `most` rows, so one task sorts them."""
    whole = Window.partitionBy()
    position = F.row_number().over(Window.orderBy("depth", F.lower("name"), "rank"))
    return hops.select("*", position.alias("position"), (F.count("*").over(whole) >= most).alias("truncated"))


class Adjacency:
    """Each edge from both of its ends, written once into buckets by node and sorted by it, in a folder that later sessions open again. A level of a search reads only the
    buckets that its frontier falls into, and in them the row groups that can hold its nodes."""

    def __init__(self, spark: SparkSession, folder: str, edges: DataFrame | None = None, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.table = f"adjacency_{hashlib.md5(self.folder.encode()).hexdigest()}"
        if edges is not None:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            rows = adjacency(edges).repartition(self.buckets, "node")
            with tidy(spark):
                rows.write.format("parquet").mode("overwrite").bucketBy(self.buckets, "node").sortBy("node").option("path", f"{self.folder}/rows").saveAsTable(self.table)
            spark.createDataFrame([(self.buckets,)], "buckets int").write.mode("overwrite").json(f"{self.folder}/made")
        else:
            self.buckets = spark.read.schema("buckets int").json(f"{self.folder}/made").first()["buckets"]
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({ADJACENT}) USING parquet CLUSTERED BY (node) SORTED BY (node) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/rows'")

    def near(self, nodes: list[str], directions: tuple[str, ...]) -> DataFrame:
        rows = self.spark.table(self.table).filter(F.col("node").isin(nodes))
        return rows if len(directions) == 2 else rows.filter(F.col("direction").isin(*directions))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.folder)


def near_edges(edges: DataFrame, nodes: list[str], directions: tuple[str, ...]) -> DataFrame:
    """The same from edges as they are: one scan, of which only edges at these nodes are turned."""
    ends = {"outgoing": F.col("source").isin(nodes), "incoming": F.col("target").isin(nodes)}
    met = edges.filter(reduce(Column.__or__, [ends[d] for d in directions]))
    return adjacency(met, directions).filter(F.col("node").isin(nodes))


def impact(spark: SparkSession, nodes: DataFrame, edges: DataFrame | Adjacency, seed: str, depth: int = 2, most: int = MOST_IMPACT, directions: tuple[str, ...] = ("outgoing", "incoming"), by_type: bool = False) -> DataFrame:
    """Breadth-first neighbourhood, undirected or along some directions: each node once, with the edge that finds it first, at most so many nodes, in the order in which
    they are found (rank): a parent's neighbours by id, or by relation and id if by_type.

    A level is one look at the edges of the frontier, which has at most `most` nodes: in edges as they are it is a scan, in an Adjacency it reads the frontier's buckets only. Of a
    node's edges the one of the parent found first, then of the least relation and direction counts. Levels are at
    most `most` rows of five short values on the driver; edges and candidates are never gathered."""
    found: list[tuple] = []
    frontier, seen = [(seed, 0)], [seed]
    for level in range(1, depth + 1):
        at = spark.createDataFrame(frontier, "node string, rank int")
        names = [x for x, _ in frontier]
        links = edges.near(names, directions) if isinstance(edges, Adjacency) else near_edges(edges, names, directions)
        near = links.filter(~F.col("next").isin(seen)).join(F.broadcast(at), "node")
        first = near.groupBy("next").agg(F.min(F.struct("rank", "type", "direction", "node")).alias("f"))
        rows = first.orderBy("f.rank", *(["f.type"] if by_type else []), "next").limit(most - len(found)).collect()
        found += [(r["next"], level, r["f"]["node"], r["f"]["type"], r["f"]["direction"], len(found) + k) for k, r in enumerate(rows)]
        frontier, seen = [(r["next"], k) for k, r in enumerate(rows)], seen + [r["next"] for r in rows]
        if not rows or len(found) >= most:
            break
    hops = spark.createDataFrame(found, "id string, depth int, via string, relation string, direction string, rank int")
    # at most `most` rows, so the nodes are read once and not moved
    known = nodes.filter(F.col("id").isin(seen)).select("id", "name", "type")
    return hops.join(known, "id", "left").select("id", F.coalesce("name", "id").alias("name"), F.coalesce("type", F.lit("Unknown")).alias("type"), "depth", "via", "relation", "direction", "rank")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members (at most MOST_IMPACT of them)."""
    m = members.select("id")
    return edges.join(F.broadcast(m.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(m.withColumnRenamed("id", "target")), "target", "left_semi").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In and out count of each node; partial counts before the shuffle carry hubs."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def default_seed(nodes: DataFrame, edges: DataFrame, lens: str) -> DataFrame:
    """The node to begin with: highest degree among the lens's preferred types, else among all that are connected, else the first node by id."""
    ranked = nodes.join(degrees(lens_edges(edges, nodes, lens)), "id", "left")
    tier = F.when(F.col("degree").isNull(), 2).when(F.col("type").isin(PREFERRED[lens]), 0).otherwise(1)
    name = F.when(F.col("degree").isNotNull(), F.lower("name"))
    return ranked.orderBy(tier, F.desc("degree"), name, "id").limit(1).select("id", "type", F.coalesce("degree", F.lit(0)).alias("degree"))


def package_list(nodes: DataFrame, edges: DataFrame, most: int = 18) -> DataFrame:
    """Packages and modules of highest degree."""
    packages = nodes.filter(F.col("type").isin("Package", "Module")).select("id", "name", "type")
    ranked = packages.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked.orderBy(F.desc("degree"), F.lower("name"), "id").limit(most)


def bounded_subgraph(members: DataFrame, edges: DataFrame, root: str, most_nodes: int = 160, most_edges: int = 480) -> tuple[DataFrame, DataFrame]:
    """The root and the first nodes by id, and the first edges among them by key, as they are drawn."""
    shown = members.select("id").distinct().orderBy(F.when(F.col("id") == root, 0).otherwise(1), "id").limit(most_nodes)
    return shown, induced(edges.select("source", "target", "type"), shown).orderBy("source", "target", "type").limit(most_edges)


def owner_trail(nodes: DataFrame, edges: DataFrame, hops: int = 6) -> DataFrame:
    """id, trail (owners from the nearest on) along incoming declarations, the least source of each, without cycles. Every node has one owner at most, so chains of owners are doubled, and each doubling is written once."""
    owner = edges.filter("type = 'DECLARES'").groupBy(F.col("target").alias("at")).agg(F.min("source").alias("parent"))
    found = chains(nodes.sparkSession, owner, hops)
    chain = F.slice("chain", 1, hops)
    # it ends before the node itself or an owner that it has already
    back = F.filter(F.sequence(F.lit(1), F.size(chain)), lambda k: (F.element_at(chain, k) == F.col("at")) | F.array_contains(F.slice(chain, F.lit(1), k - 1), F.element_at(chain, k)))
    trail = F.slice(chain, F.lit(1), F.coalesce(F.get(back, F.lit(0)), F.size(chain) + 1) - 1)
    trails = found.select(F.col("at").alias("id"), trail.alias("trail"))
    return nodes.select("id").join(trails, "id", "left").select("id", F.coalesce("trail", F.array().cast("array<string>")).alias("trail"))


#: Hash buckets in which groups are counted to find the large ones, the share of rows that is counted, and the parts that a large group is dealt into.
COUNTED, SEEN, PARTS = 1 << 16, 0.02, 64


def grouped_relations(edges: DataFrame, most: int = 18) -> DataFrame:
    """For each node, direction and relation: the first neighbours by id and how many there are. Rows are moved once, by group, and counted in the order of their neighbours. Groups in buckets that hold more
    than a fourth of a task's share are dealt into PARTS by neighbour, each with its own first ones, so a hub fills no task. Some rows tell which groups those are, as with ranges; it changes where rows go and no result."""
    near, group = adjacency(edges), ["node", "direction", "type"]
    bucket = F.pmod(F.xxhash64(*group), F.lit(COUNTED))
    counts = adjacency(edges.sample(SEEN, 42)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()  # COUNTED rows at most
    share = sum(r["n"] for r in counts) / (4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = [r["b"] for r in counts if r["n"] > max(share, most)]  # fewer than four for each task

    def first(rows: DataFrame, by: list[str]) -> DataFrame:
        # the hash goes first in the sort, as ids of one kind begin alike; the nth neighbour is the greatest of those at place n, so ranked rows are folded as they come
        dealt = rows.repartition(*by).withColumn("__h", F.xxhash64(*by))
        ranked = dealt.select("__h", *by, "next", F.dense_rank().over(Window.partitionBy("__h", *by).orderBy("next")).alias("k"))
        nth = F.array(*[F.max(F.when(F.col("k") == i, F.col("next"))) for i in range(1, most + 1)])
        return ranked.groupBy("__h", *by).agg(F.max("k").cast("long").alias("n"), F.array_compact(nth).alias("first")).drop("__h")

    if not large:
        return first(near, group)
    hot = bucket.isin(large)
    parts = first(near.filter(hot).withColumn("__part", F.pmod(F.xxhash64("next"), F.lit(PARTS))), [*group, "__part"])
    whole = parts.groupBy(*group).agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, most).alias("first"))
    return first(near.filter(~hot), group).unionByName(whole)
