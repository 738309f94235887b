"""The registered queries: operators applied to whole tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.functions.text import in_java
from loomgraph.operators import enrich, graph, merge, nesting, snapshots
from loomgraph.schemas import ABSOLUTE_PATHS
from loomgraph.sources import star
from loomgraph.tables import stage

FLAGSHIP = "impact_neighbourhood"
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Package' AS type, r_name AS name, 'Python' AS language FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Module', n_name, 'Python' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'Class', c_name, 'Java' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Interface', s_name, 'Java' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'PolicyLeaf', p_name, 'Policy' FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'Method', 'order ' || o_orderkey, 'Java' FROM orders
)"""
EDGES = """edges AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'DECLARES' AS type FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'DECLARES' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'DECLARES' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'CALLS' FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'READS_POLICY_LEAF' FROM lineitem
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'INJECTS' FROM lineitem
)"""
EVIDENCE = """items AS (
  SELECT 'part:' || l_partkey AS source, 'supplier:' || l_suppkey AS target,
         CASE WHEN l_linestatus = 'O' THEN 'resolved_static' ELSE 'direct_syntax' END AS basis, l_linenumber AS line_start,
         'lineitem.' || lower(l_returnflag) AS rule_id, CASE WHEN l_returnflag = 'R' THEN 'runtime_unknown' ELSE 'not_applicable' END AS runtime_status
  FROM lineitem
), canon AS (
  SELECT *, '{"basis":"' || basis || '","line_start":' || line_start || ',"rule_id":"' || rule_id || '","runtime_status":"' || runtime_status || '"}' AS canon FROM items
)"""
ADJACENT = "adj AS (SELECT source AS node, target AS next, type, 'outgoing' AS direction FROM edges UNION ALL SELECT target, source, type, 'incoming' FROM edges)"


def query(sql: str = ""):
    def register(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def load() -> None:
    """The queries that are registered elsewhere."""
    from loomgraph.plans import contract, lexical  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_sql)


@query(f"WITH {NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_type_histogram(spark, d):
    return star.nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT type, count(*) AS n FROM edges GROUP BY type")
def edge_type_histogram(spark, d):
    return star.edges(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {EDGES} SELECT source, target, type, count(*) AS n FROM edges WHERE source <> target GROUP BY source, target, type")
def edge_dedup(spark, d):
    return merge.dedup_edges(star.edges(spark, d))


@query(f"""WITH {EVIDENCE}, k AS (SELECT source, target, canon, row_number() OVER (PARTITION BY source, target ORDER BY canon) AS k FROM (SELECT DISTINCT source, target, canon FROM canon))
SELECT source, target, string_agg(canon, ',' ORDER BY canon) AS evidence, count(*) AS n FROM k WHERE k <= 16 GROUP BY source, target""")
def evidence_bounded_merge(spark, d):
    merged = merge.bounded_evidence(star.evidence(spark, d))
    return merged.select("source", "target", F.array_join("evidence", ",").alias("evidence"), F.size("evidence").cast("long").alias("n"))


@query("""WITH p AS (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey)
SELECT count(*) AS total, count_if(n > 0) AS documented, count_if(n = 0) AS missing, CASE WHEN count(*) = 0 THEN 100.0 ELSE round(100.0 * count_if(n > 0) / count(*), 3) END AS coverage_percent FROM p""")
def evidence_coverage(spark, d):
    items = star.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    p = star.table(spark, d, "part").select("p_partkey").join(items, "p_partkey", "left")
    found = F.count_if(F.col("n").isNotNull())
    return p.agg(F.count("*").alias("total"), found.alias("documented"), F.count_if(F.col("n").isNull()).alias("missing"), F.when(F.count("*") == 0, 100.0).otherwise(F.round(100.0 * found / F.count("*"), 3)).alias("coverage_percent"))


@query(f"WITH {EVIDENCE} SELECT basis, runtime_status, count(*) AS n FROM items GROUP BY basis, runtime_status")
def evidence_counts(spark, d):
    return star.evidence(spark, d).groupBy("item.basis", "item.runtime_status").agg(F.count("*").alias("n"))


@query("""WITH f AS (
  SELECT 'customer:' || o_custkey AS id, 2 * o_orderkey AS ord, CASE WHEN o_orderstatus = 'F' THEN 'Class' ELSE 'ExternalType' END AS type, CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderpriority END AS path FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 2 * c_custkey + 1, 'ExternalModule', c_mktsegment FROM customer
)
SELECT id, coalesce(arg_min(type, ord) FILTER (WHERE type NOT LIKE 'External%'), arg_min(type, ord)) AS type, arg_min(path, ord) FILTER (WHERE path <> '') AS path FROM f GROUP BY id""")
def node_merge_first_wins(spark, d):
    o, c = star.table(spark, d, "orders"), star.table(spark, d, "customer")
    found = o.select(star.node_id("customer", "o_custkey").alias("id"), (2 * F.col("o_orderkey")).alias("ord"), F.when(F.col("o_orderstatus") == "F", "Class").otherwise("ExternalType").alias("type"), F.when(F.col("o_orderpriority").like("1%"), "").otherwise(F.col("o_orderpriority")).alias("path"))
    return merge.merge_nodes(found.unionByName(c.select(star.node_id("customer", "c_custkey").alias("id"), (2 * F.col("c_custkey") + 1).alias("ord"), F.lit("ExternalModule").alias("type"), F.col("c_mktsegment").alias("path"))), "ord", ["path"])


@query(f"""WITH ph AS (SELECT 'part:' || p_partkey AS id, p_brand AS language, p_type AS qualified_name, p_name AS name FROM part WHERE p_size > 25),
i AS (SELECT 'part:' || p_partkey AS id, p_brand AS language, p_type AS qualified_name, p_name AS name, p_partkey AS ordinal FROM part WHERE p_size <= 25),
x AS (SELECT language, qualified_name, arg_max(id, ordinal) AS by_name FROM i GROUP BY ALL), s AS (SELECT name, min(id) AS by_simple FROM i GROUP BY name HAVING count(*) = 1),
r AS (SELECT ph.id, coalesce(by_name, CASE WHEN ph.qualified_name NOT LIKE '%.%' THEN by_simple END) AS t FROM ph LEFT JOIN x USING (language, qualified_name) LEFT JOIN s ON s.name = ph.name),
{EDGES}, m AS (SELECT coalesce(a.t, source) AS source, coalesce(b.t, target) AS target, type FROM edges LEFT JOIN r a ON a.id = source AND a.t IS NOT NULL LEFT JOIN r b ON b.id = target AND b.t IS NOT NULL)
SELECT source, target, type, count(*) AS n FROM m WHERE source <> target GROUP BY ALL""")
def reconcile_placeholders(spark, d):
    p = star.table(spark, d, "part").select(star.node_id("part", "p_partkey").alias("id"), F.col("p_brand").alias("language"), F.col("p_type").alias("qualified_name"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"), "p_size")
    r = merge.redirects(p.filter("p_size > 25").drop("ordinal", "p_size"), p.filter("p_size <= 25").drop("p_size"))
    return merge.rewrite_edges(star.edges(spark, d), r)


@query("""WITH one AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS target FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) = 1)
SELECT l_orderkey, l_linenumber, target, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN one USING (p_brand, p_type, p_size) GROUP BY ALL""")
def unique_target_join(spark, d):
    p = star.table(spark, d, "part")
    calls = star.table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand", "p_type", "p_size")
    return merge.unique_target(calls, p, ["p_brand", "p_type", "p_size"], "p_partkey").groupBy("l_orderkey", "l_linenumber", "target").agg(F.count("*").alias("n"))


@query("""SELECT p.o_orderkey, arg_max(s.o_orderkey, (s.o_orderdate, s.o_orderkey)) AS scope FROM orders p JOIN orders s ON p.o_custkey = s.o_custkey AND s.o_orderdate < p.o_orderdate + INTERVAL 30 DAY AND p.o_orderdate + INTERVAL 30 DAY < s.o_orderdate + INTERVAL 90 DAY GROUP BY p.o_orderkey""")
def innermost_scope(spark, d):
    o = star.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', o_orderdate)").alias("begin"))
    day, begin = 86_400, F.col("begin")
    return nesting.innermost(spark, o, o.withColumnRenamed("o_orderkey", "scope"), "o_custkey", "o_orderkey", begin + 30 * day, "scope", begin, begin + 90 * day).select("o_orderkey", "scope")


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.ts < e.ts AND e.ts < x.ts + INTERVAL 1 DAY)")
def interval_anti_join(spark, d):
    e = star.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    bad = e.filter("event_type = 'error'").select("user_id", F.col("ts").alias("b"))
    return merge.outside(e, bad, "user_id", F.col("ts"), F.col("b"), F.expr("b + INTERVAL 1 DAY"), lambda x: F.datediff(x, F.lit("1970-01-01"))).select("event_id")


@query(f"WITH {NODES} SELECT id, name, type FROM nodes WHERE contains(lower(id || ' ' || type || ' ' || name || ' ' || language), 'supplier') ORDER BY lower(name), id LIMIT 200")
def search_substring(spark, d):
    return graph.search(star.nodes(spark, d), "supplier").select("id", "name", "type")


@query(f"""WITH {NODES}, s AS (SELECT id, name, type, CASE WHEN lower(name) = 'order 12' THEN 0 WHEN lower(id) = 'order 12' THEN 1 WHEN starts_with(lower(name), 'order 12') THEN 2 WHEN starts_with(lower(id), 'order 12') THEN 4
 WHEN contains(lower(id || ' ' || type || ' ' || name || ' ' || language), 'order 12') THEN 5 END AS score FROM nodes WHERE language = 'Java')
SELECT id, name, type, score FROM s WHERE score IS NOT NULL ORDER BY score, CASE type WHEN 'Class' THEN 2 WHEN 'Interface' THEN 3 WHEN 'Method' THEN 7 ELSE 20 END, lower(name), id LIMIT 200""")
def search_ranked(spark, d):
    return graph.ranked_search(star.nodes(spark, d), "Order 12", language="Java").select("id", "name", "type", "score")


def _levels(seed: str, most: int) -> str:
    """SQL of a two-level neighbourhood."""
    return f"""WITH {NODES}, {EDGES}, {ADJACENT},
c1 AS (SELECT next, type, direction, node, row_number() OVER (PARTITION BY next ORDER BY type, direction) AS k FROM adj WHERE node = '{seed}' AND next <> '{seed}'),
l1 AS (SELECT next AS id, 1 AS depth, node AS via, type AS relation, direction, row_number() OVER (ORDER BY next) - 1 AS rank FROM c1 WHERE k = 1),
l1c AS MATERIALIZED (SELECT * FROM l1 WHERE rank < {most}),
c2 AS (SELECT a.next, a.type, a.direction, a.node, p.rank, row_number() OVER (PARTITION BY a.next ORDER BY p.rank, a.type, a.direction) AS k FROM adj a JOIN l1c p ON a.node = p.id WHERE a.next <> '{seed}' AND a.next NOT IN (SELECT id FROM l1c)),
l2 AS (SELECT next AS id, 2 AS depth, node AS via, type AS relation, direction, row_number() OVER (ORDER BY rank, next) - 1 AS rank FROM c2 WHERE k = 1),
hops AS (SELECT * FROM l1c UNION ALL SELECT * FROM l2 WHERE rank < {most} - (SELECT count(*) FROM l1c))"""


@query(_levels("nation:3", 2000) + " SELECT h.id, coalesce(n.name, h.id) AS name, coalesce(n.type, 'Unknown') AS type, depth, via, relation, direction FROM hops h LEFT JOIN nodes n USING (id)")
def impact_neighbourhood(spark, d):
    return graph.impact(spark, star.nodes(spark, d), star.edges(spark, d), "nation:3", 2).drop("rank")


@query(_levels("region:1", 240).replace("adj AS (", "raw AS (SELECT * FROM edges), lens AS (SELECT source, target, type FROM raw WHERE type = 'DECLARES'), adj AS (").replace("FROM edges UNION", "FROM lens UNION").replace("'incoming' FROM edges)", "'incoming' FROM lens)") + ", m AS (SELECT id FROM hops UNION SELECT 'region:1') SELECT DISTINCT source, target, type FROM lens SEMI JOIN m a ON a.id = source SEMI JOIN m b ON b.id = target")
def lens_neighbourhood(spark, d):
    nodes = star.nodes(spark, d)
    # written once: each level and the edges in between read it
    edges = stage(spark, graph.lens_edges(star.edges(spark, d), nodes, "architecture", "region:1"), "lens")
    hops = graph.impact(spark, nodes, edges, "region:1", 2, 240)
    return graph.induced(edges, hops.select("id").union(spark.createDataFrame([("region:1",)], "id string")))


@query("""WITH t AS (SELECT 'customer:' || c_custkey AS id, 'nation:' || n_nationkey || ',region:' || n_regionkey AS trail FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || n_nationkey || ',region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'region:' || r_regionkey, '' FROM region
 UNION ALL SELECT 'part:' || p_partkey, '' FROM part UNION ALL SELECT 'order:' || o_orderkey, '' FROM orders) SELECT id, trail FROM t""")
def owner_trail(spark, d):
    return graph.owner_trail(star.nodes(spark, d), star.edges(spark, d)).select("id", F.array_join("trail", ",").alias("trail"))


@query(f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def degrees(spark, d):
    return graph.degrees(star.edges(spark, d))


@query(f"""WITH {NODES}, {EDGES}, g AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)
SELECT id, type, degree FROM nodes JOIN g USING (id) ORDER BY CASE WHEN type IN ('Package', 'Module', 'Class', 'PolicyLeaf', 'PipelineRole') THEN 0 ELSE 1 END, degree DESC, lower(name), id LIMIT 1""")
def default_seed(spark, d):
    return graph.default_seed(star.nodes(spark, d), star.edges(spark, d), "explore")


@query(f"""WITH {EDGES}, {ADJACENT}, a AS (SELECT DISTINCT node, next, type, direction FROM adj), k AS (SELECT *, row_number() OVER (PARTITION BY node, direction, type ORDER BY next) AS k FROM a)
SELECT node, direction, type, count(*) AS n, string_agg(next, ',' ORDER BY next) FILTER (WHERE k <= 18) AS first FROM k GROUP BY node, direction, type""")
def grouped_relations(spark, d):
    return graph.grouped_relations(star.edges(spark, d)).withColumn("first", F.array_join("first", ","))


@query("""WITH b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT o_custkey, o_orderpriority, 'added' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT o_custkey, o_orderpriority, 'removed' FROM (FROM b EXCEPT FROM a)""")
def diff_added_removed(spark, d):
    o = star.table(spark, d, "orders")
    return snapshots.diff_keys(o.filter("o_orderdate < TIMESTAMP_NTZ '1998-01-01'"), o.filter("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'"), ["o_custkey", "o_orderpriority"])


@query("""WITH s AS (SELECT o_custkey, o_orderdate < TIMESTAMP '1998-01-01' AS old, max(o_orderpriority) AS p, max(o_orderstatus) AS q FROM orders GROUP BY ALL)
SELECT a.o_custkey FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND NOT a.old AND b.old WHERE (a.p, a.q) IS DISTINCT FROM (b.p, b.q)""")
def diff_modified(spark, d):
    s = star.table(spark, d, "orders").groupBy("o_custkey", (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1998-01-01'")).alias("old")).agg(F.max("o_orderpriority").alias("p"), F.max("o_orderstatus").alias("q"))
    return snapshots.diff_modified(s.filter("old"), s.filter("not old"), "o_custkey", ["p", "q"])


BASIS = "CASE WHEN fa IS NULL OR fb IS NULL THEN 'legacy_unknown' WHEN fa <> fb AND k AND (aa <> ab OR ca <> cb) THEN 'mixed' WHEN fa <> fb THEN 'source_change' WHEN NOT k THEN 'legacy_unknown' WHEN aa <> ab THEN 'analyzer_reinterpretation' WHEN ca <> cb THEN 'analysis_refresh' ELSE 'no_change' END"


@query(f"""WITH x AS (SELECT user_id, event_type AS fb, CAST(event_id % 2 AS VARCHAR) AS ab, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id % 3 AS VARCHAR) END AS cb,
 lag(event_type) OVER w AS fa, lag(CAST(event_id % 2 AS VARCHAR)) OVER w AS aa, lag(CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id % 3 AS VARCHAR) END) OVER w AS ca FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, coalesce(aa <> '' AND ab <> '' AND ca <> '' AND cb <> '', false) AS k FROM x) SELECT {BASIS} AS basis, count(*) AS n FROM y GROUP BY 1""")
def change_basis(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = star.table(spark, d, "events")
    e = e.select("user_id", "ts", "event_id", F.col("event_type").alias("fb"), (F.col("event_id") % 2).cast("string").alias("ab"), F.when(F.col("event_id") % 7 == 0, "").otherwise((F.col("event_id") % 3).cast("string")).alias("cb"))
    e = e.select("*", F.lag("fb").over(w).alias("fa"), F.lag("ab").over(w).alias("aa"), F.lag("cb").over(w).alias("ca"))
    return e.groupBy(snapshots.change_basis(*[F.col(c) for c in ("fa", "fb", "aa", "ab", "ca", "cb")]).alias("basis")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 500")
def lineage_filtered(spark, d):
    return star.table(spark, d, "events").filter("event_type = 'purchase'").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type", "user_id")


ROLE = "CASE " + " ".join(f"WHEN list_has_any(t, {w}) THEN '{r}'" for r, w in X.ROLE_TOKENS.items()) + " END"
TOKENS = "list_filter(regexp_split_to_array(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda z: z <> '')"


@query(f"WITH n AS (SELECT event_id, event_type || CASE WHEN value > 50 THEN 'Store' ELSE 'Check' END || '_' || props AS name FROM events), k AS (SELECT event_id, {TOKENS.format(x='name')} AS t FROM n) SELECT event_id, {ROLE} AS role, array_to_string(t, ' ') AS tokens FROM k")
def role_classify(spark, d):
    name = F.concat("event_type", F.when(F.col("value") > 50, "Store").otherwise("Check"), F.lit("_"), "props")
    t = star.table(spark, d, "events").select("event_id", X.name_tokens(name).alias("t"))
    return t.select("event_id", X.pipeline_role(F.col("t")).alias("role"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT doc_id, len({TOKENS.format(x='text')}) AS n_tokens FROM documents")
def name_tokens(spark, d):
    return star.table(spark, d, "documents").select("doc_id", F.size(X.name_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/?', '') AS u, url FROM pages)
SELECT page_id, NOT (x = '' OR length(x) > 4096 OR regexp_matches(x, '[\x00-\x1F\x7F]') OR regexp_matches(x, '^[/\\]') OR regexp_matches(x, '^[A-Za-z]:[/\\]') OR list_contains(string_split(replace(x, '\', '/'), '/'), '..')) AS portable FROM (SELECT page_id, u AS x FROM p)""")
def portable_path(spark, d):
    return star.table(spark, d, "pages").select("page_id", X.portable_path(F.regexp_replace("url", "^https?://[^/]*/?", "")).alias("portable"))


def unsafe_sql(column: str) -> str:
    """SQL of unsafe_text. DuckDB's patterns look at nothing before or behind a match, so what must not stand there is matched; web addresses lose their colon before."""
    plain = f"regexp_replace({column}, '(?i)(https?):/', '\\1/', 'g')"
    tests = []
    for p in ABSOLUTE_PATHS:
        p = p.replace("(?<!http:)(?<!https:)", "").replace(r"(?!\\)(?=\S)", r"[^\\\s]")
        p = re.sub(r"\(\?<!\[((?:\\.|[^\]])*)\]\)", lambda m: f"(^|[^{m[1]}])", p)
        tests.append(f"regexp_matches({plain}, '{re.sub(r'[(][?]=(.*)[)]$', lambda m: m[1], in_java(p))}')")
    return f"(regexp_matches({column}, '[\\p{{Cc}}\\p{{Cf}}]') OR " + " OR ".join(tests) + ")"


@query(f"SELECT doc_id, coalesce({unsafe_sql('text')}, false) AS unsafe FROM documents")
def unsafe_text(spark, d):
    return star.table(spark, d, "documents").select("doc_id", X.unsafe_text(F.col("text")).alias("unsafe"))


@query(f"WITH {EDGES}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY type, target) AS k FROM (SELECT DISTINCT * FROM edges)) SELECT source, type, target, k FROM k WHERE k <= 12")
def relations_topk_per_candidate(spark, d):
    return enrich.top_relations(star.edges(spark, d))


@query("""WITH RECURSIVE f AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT source, doc_id, k, 0 AS batch, 1 AS n, n_chars AS bytes FROM f WHERE k = 1
 UNION ALL SELECT f.source, f.doc_id, f.k, r.batch + CASE WHEN r.n >= 20 OR r.bytes + f.n_chars > 16384 THEN 1 ELSE 0 END, CASE WHEN r.n >= 20 OR r.bytes + f.n_chars > 16384 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 20 OR r.bytes + f.n_chars > 16384 THEN f.n_chars ELSE r.bytes + f.n_chars END
 FROM r JOIN f ON f.source = r.source AND f.k = r.k + 1 AND f.k <= 80)
SELECT source, doc_id, batch FROM r""")
def greedy_batches(spark, d):
    return enrich.greedy_batches(enrich.first_candidates(star.table(spark, d, "documents"), "source", "doc_id"), "source", "doc_id", "n_chars")


@query("""WITH RECURSIVE f AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT source, doc_id, k, 0 AS batch, 1 AS n, n_chars AS bytes FROM f WHERE k = 1
 UNION ALL SELECT f.source, f.doc_id, f.k, r.batch + CASE WHEN r.n >= 20 OR r.bytes + f.n_chars > 16384 THEN 1 ELSE 0 END, CASE WHEN r.n >= 20 OR r.bytes + f.n_chars > 16384 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 20 OR r.bytes + f.n_chars > 16384 THEN f.n_chars ELSE r.bytes + f.n_chars END
 FROM r JOIN f ON f.source IS NOT DISTINCT FROM r.source AND f.k = r.k + 1)
SELECT source, doc_id, batch FROM r""")
def greedy_batches_all(spark, d):
    return enrich.greedy_batches(star.table(spark, d, "documents"), "source", "doc_id", "n_chars")


@query("SELECT user_id, min(event_type) AS role, min(value) AS confidence, count(*) AS n FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id, date_trunc('day', ts) HAVING count(DISTINCT event_type) = 1")
def suggestion_merge(spark, d):
    e = star.table(spark, d, "events").filter("event_type in ('signup', 'error')").select(F.struct("user_id", F.date_trunc("day", "ts").alias("day")).alias("node"), "event_type", "value")
    return enrich.merge_suggestions(e, "node", "event_type", "value").select("node.user_id", "role", "confidence", "n")


@query("""WITH c AS (SELECT count_if(quality = 0 AND toxic = 1) AS tp, count_if(quality <> 0 AND toxic = 1) AS fp, count_if(quality = 0 AND toxic <> 1) AS fn FROM labels)
SELECT tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE round(tp / (tp + fn), 6) END AS recall FROM c""")
def quality_metrics(spark, d):
    toxic, low = F.col("toxic") == 1, F.col("quality") == 0
    c = star.table(spark, d, "labels").agg(F.count_if(toxic & low).alias("tp"), F.count_if(toxic & ~low).alias("fp"), F.count_if(~toxic & low).alias("fn"))
    rate = lambda b: F.when(F.col("tp") + F.col(b) == 0, 1.0).otherwise(F.round(F.col("tp") / (F.col("tp") + F.col(b)), 6))
    return c.select("*", rate("fp").alias("precision"), rate("fn").alias("recall"))


@query("""WITH m AS (SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents), i AS (SELECT substr(sha256(path), 1, 2) AS g, sha256(path || ':' || sha256) AS i FROM m), x AS (SELECT g, sha256(string_agg(i, '' ORDER BY i)) AS d, count(*) AS n FROM i GROUP BY g)
SELECT sha256(string_agg(g || d, '' ORDER BY g || d)) AS fingerprint, CAST(sum(n) AS BIGINT) AS files FROM x""")
def manifest_digest(spark, d):
    return snapshots.fingerprint_flat(star.table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256")))


@query(f"""WITH {EDGES} SELECT DISTINCT '<urn:node:' || replace(source, ':', '%3A') || '> <urn:graph:' || CASE type WHEN 'DECLARES' THEN 'Declares' WHEN 'CALLS' THEN 'Calls' WHEN 'INJECTS' THEN 'Injects' ELSE 'ReadsPolicyLeaf' END || '> <urn:node:' || replace(target, ':', '%3A') || '> .' AS line FROM edges""")
def turtle_export(spark, d):
    iri = lambda c: F.concat(F.lit("<urn:node:"), X.percent_encode(F.col(c)), F.lit(">"))
    return star.edges(spark, d).select(F.concat_ws(" ", iri("source"), F.concat(F.lit("<urn:graph:"), X.predicate_name(F.col("type")), F.lit(">")), iri("target"), F.lit(".")).alias("line")).distinct()


@query("""SELECT doc_id, turn_literal AS literal FROM (SELECT doc_id, '"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') || '"' AS turn_literal FROM documents)""".replace("\\\\", "\\"))
def turtle_literals(spark, d):
    return star.table(spark, d, "documents").select("doc_id", X.turtle_literal(F.col("text")).alias("literal"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS ordinal FROM pages)
SELECT page_id, target, count(*) AS n, min(ordinal) AS first FROM a GROUP BY page_id, target""")
def page_links(spark, d):
    links = star.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("k", "target"))
    return links.groupBy("page_id", "target").agg(F.count("*").alias("n"), (F.min("k") + 1).cast("long").alias("first"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS ordinal, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_turn FROM conversations")
def branch_ordinal(spark, d):
    from pyspark.sql import Window

    c = star.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return c.withColumn("ordinal", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))).withColumn("previous_turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))


@query(f"WITH {NODES} SELECT id, list_reduce(list_transform(string_split(id, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)) AS hash FROM nodes")
def layout_hash(spark, d):
    return star.nodes(spark, d).select("id", X.fnv1a(F.col("id")).alias("hash"))


@query("SELECT doc_id, len(text) - len(replace(text, chr(10), '')) + 1 AS lines, CASE WHEN len(text) > 80 THEN text[1:79] || '…' ELSE text END AS preview FROM documents")
def line_counts(spark, d):
    t = F.col("text")
    return star.table(spark, d, "documents").select("doc_id", X.line_of(t, F.char_length(t) + 1).cast("long").alias("lines"), X.ellipsis(t, 80).alias("preview"))
