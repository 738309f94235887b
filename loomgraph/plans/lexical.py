"""Registered queries of scopes, flows, nested structures, masks, limits and stored adjacency, each with the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import flow, folds, graph, merge, nesting, projections
from loomgraph.plans.registry import EDGES, _levels, query
from loomgraph.schemas import EDGE_RULES, RUNTIME_SENSITIVE
from loomgraph.sources import code, star
from loomgraph.tables import shared_dir


@query("""WITH RECURSIVE scopes AS (
  SELECT 'region:' || r_regionkey AS scope, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS class FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'type.C' || c_custkey END FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, NULL FROM orders
), b AS (
  SELECT 'region:' || r_regionkey AS scope, 'n' || (r_regionkey % 7) AS name, 'import' AS kind, 'lib.r' || r_regionkey AS target FROM region
  UNION ALL SELECT 'region:' || r_regionkey, 'n' || ((r_regionkey + k) % 7), 'symbol', 'mod' || r_regionkey || '.f' || k FROM region, (SELECT unnest([0, 2, 3]) AS k)
  UNION ALL SELECT 'nation:' || n_nationkey, 'n' || (n_nationkey % 7), ['local', 'symbol', 'import', 'global'][n_nationkey % 4 + 1], 'nat.x' || n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'n' || (c_custkey % 7), ['local', 'symbol', 'import', 'global'][(c_custkey + 1) % 4 + 1], 'cus.y' || c_custkey FROM customer WHERE c_custkey % 2 = 1
  UNION ALL SELECT 'order:' || o_orderkey, 'n' || (o_orderkey % 7), ['local', 'symbol', 'import', 'global'][(o_orderkey + 2) % 4 + 1], 'ord.z' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'order:' || o_orderkey, 'n' || (o_orderkey % 7), 'local', NULL FROM orders WHERE o_orderkey % 6 = 0
), best AS (SELECT scope, name, arg_min(kind, r) AS kind, arg_min(coalesce(target, ''), r) AS target FROM (SELECT *, CASE kind WHEN 'global' THEN 0 WHEN 'symbol' THEN 1 WHEN 'import' THEN 2 ELSE 3 END AS r FROM b) GROUP BY scope, name
), refs AS (
  SELECT 'order:' || l_orderkey AS scope, CASE WHEN l_quantity < 5 THEN 'self.m' || (l_partkey % 3) WHEN l_suppkey % 2 = 0 THEN 'n' || (l_partkey % 7) || '.m.k' ELSE 'n' || (l_partkey % 7) END AS name FROM lineitem
), w AS (
  SELECT DISTINCT scope, name, split_part(name, '.', 1) AS f, substr(name, length(split_part(name, '.', 1)) + 1) AS rest FROM refs
), climb AS (
  SELECT w.scope, w.name, w.f, w.rest, w.scope AS here, CAST(NULL AS VARCHAR) AS how, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS bound FROM w
  UNION ALL
  SELECT c.scope, c.name, c.f, c.rest, CASE WHEN b.kind IS NULL THEN s.parent ELSE c.here END, CASE WHEN b.kind = 'global' THEN 'global' ELSE b.kind END, b.target, CASE WHEN b.kind <> 'global' THEN c.here END
  FROM climb c JOIN scopes s ON s.scope = c.here LEFT JOIN best b ON b.scope = c.here AND b.name = c.f WHERE c.how IS NULL AND s.parent IS NOT NULL
), own AS (
  SELECT scope, scope AS here, class FROM scopes UNION ALL SELECT own.scope, s.parent, p.class FROM own JOIN scopes s ON s.scope = own.here JOIN scopes p ON p.scope = s.parent WHERE own.class IS NULL
), classes AS (SELECT scope, class FROM own WHERE class IS NOT NULL
), tops AS (SELECT scope, scope AS here, parent FROM scopes UNION ALL SELECT t.scope, s.scope, s.parent FROM tops t JOIN scopes s ON s.scope = t.parent
), root AS (SELECT scope, here AS module FROM tops WHERE parent IS NULL
), ended AS (SELECT scope, name, f, rest, max(how) AS how, max(target) AS target, max(bound) AS bound FROM climb GROUP BY ALL
), m AS (SELECT scope, name, arg_min(kind, CASE kind WHEN 'import' THEN 0 ELSE 1 END) AS kind, arg_min(target, CASE kind WHEN 'import' THEN 0 ELSE 1 END) AS target FROM b WHERE kind IN ('import', 'symbol') AND scope LIKE 'region:%' GROUP BY ALL
), out AS (
  SELECT e.scope, e.name, CASE WHEN c.class IS NOT NULL AND e.f = 'self' AND e.rest <> '' THEN 'self' WHEN e.how IN ('symbol', 'import', 'local') THEN e.how WHEN m.kind = 'import' OR (m.kind = 'symbol' AND e.rest = '') THEN 'module_' || m.kind ELSE 'unresolved' END AS how,
         c.class, e.rest, e.target, e.bound, m.target AS m_target, r.module
  FROM ended e LEFT JOIN classes c ON c.scope = e.scope JOIN root r ON r.scope = e.scope LEFT JOIN m ON m.scope = r.module AND m.name = e.f
)
SELECT scope, name, how, CASE how WHEN 'self' THEN class || rest WHEN 'symbol' THEN target || rest WHEN 'import' THEN target || rest WHEN 'module_import' THEN m_target || rest WHEN 'module_symbol' THEN m_target ELSE name END AS qualified,
       CASE WHEN how IN ('symbol', 'import', 'local') THEN bound WHEN how LIKE 'module_%' THEN module END AS bound_in, count(*) AS n
FROM out JOIN refs USING (scope, name) GROUP BY ALL""")
def scope_resolution(spark, d):
    t = lambda name: star.table(spark, d, name)
    none = F.lit(None).cast("string")
    scopes = [
        t("region").select(star.node_id("region", "r_regionkey").alias("scope"), none.alias("parent"), none.alias("class")),
        t("nation").select(star.node_id("nation", "n_nationkey").alias("scope"), star.node_id("region", "n_regionkey").alias("parent"), none.alias("class")),
        t("customer").select(star.node_id("customer", "c_custkey").alias("scope"), star.node_id("nation", "c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("type.C"), "c_custkey")).alias("class")),
        t("orders").select(star.node_id("order", "o_orderkey").alias("scope"), star.node_id("customer", "o_custkey").alias("parent"), none.alias("class")),
    ]
    kinds = lambda key, shift: F.element_at(F.array(*map(F.lit, ("local", "symbol", "import", "global"))), ((F.col(key) + shift) % 4 + 1).cast("int"))
    name = lambda key, shift=0: F.concat(F.lit("n"), (F.col(key) + shift) % 7)
    bound = lambda df, kind, key, what, target: df.select(star.node_id(kind, key).alias("scope"), name(key).alias("name"), what.alias("kind"), target.alias("target"))
    some = lambda prefix, key: F.concat(F.lit(prefix), F.col(key))
    region, order = t("region"), t("orders")
    module = [region.select(star.node_id("region", "r_regionkey").alias("scope"), name("r_regionkey", k).alias("name"), F.lit("symbol").alias("kind"), F.concat(F.lit("mod"), "r_regionkey", F.lit(f".f{k}")).alias("target")) for k in (0, 2, 3)]
    bindings = [
        bound(region, "region", "r_regionkey", F.lit("import"), some("lib.r", "r_regionkey")), *module, bound(t("nation"), "nation", "n_nationkey", kinds("n_nationkey", 0), some("nat.x", "n_nationkey")),
        bound(t("customer").filter("c_custkey % 2 = 1"), "customer", "c_custkey", kinds("c_custkey", 1), some("cus.y", "c_custkey")), bound(order.filter("o_orderkey % 3 = 0"), "order", "o_orderkey", kinds("o_orderkey", 2), some("ord.z", "o_orderkey")),
        bound(order.filter("o_orderkey % 6 = 0"), "order", "o_orderkey", F.lit("local"), none),
    ]
    dotted = F.when(F.col("l_quantity") < 5, F.concat(F.lit("self.m"), F.col("l_partkey") % 3)).when(F.col("l_suppkey") % 2 == 0, F.concat(name("l_partkey"), F.lit(".m.k"))).otherwise(name("l_partkey"))
    refs = t("lineitem").select(star.node_id("order", "l_orderkey").alias("scope"), dotted.alias("name"))
    refs = refs.groupBy("scope", "name").agg(F.count("*").alias("n")).withColumn("ref", F.struct("scope", "n"))
    tree, every = scopes[0], bindings[0]
    for x in scopes[1:]:
        tree = tree.unionByName(x)
    for x in bindings[1:]:
        every = every.unionByName(x)
    found = nesting.resolved(spark, refs, tree, every)
    return found.select("ref.scope", "name", "how", "qualified", "bound_in", "ref.n")


_STATEMENT = """CASE event_type WHEN 'purchase' THEN 'read' WHEN 'error' THEN 'condition' ELSE 'assign' END AS kind, 'v' || (event_id % 3) AS variable,
 CASE WHEN event_type = 'error' THEN ['v' || (event_id % 3), 'v' || (event_id // 3 % 3)] WHEN event_type IN ('click', 'view') THEN ['v' || (event_id // 3 % 3)] WHEN event_type = 'signup' AND event_id % 2 = 0 THEN ['v' || (event_id % 3)] ELSE [] END AS uses"""


@query(f"""WITH RECURSIVE s AS (SELECT user_id, event_id, {_STATEMENT}, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, 0 AS k, CAST([] AS BIGINT[]) AS a, CAST([] AS BIGINT[]) AS b, CAST([] AS BIGINT[]) AS c, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS BIGINT) AS condition FROM (SELECT DISTINCT user_id FROM s)
 UNION ALL SELECT user_id, k, CASE WHEN kind <> 'condition' AND variable = 'v0' THEN new ELSE a END, CASE WHEN kind <> 'condition' AND variable = 'v1' THEN new ELSE b END, CASE WHEN kind <> 'condition' AND variable = 'v2' THEN new ELSE c END,
  CASE WHEN kind = 'condition' THEN held ELSE [] END, event_id
 FROM (SELECT s.user_id, s.k, s.kind, s.variable, s.event_id, r.a, r.b, r.c, list_distinct(list_concat(CASE WHEN list_contains(s.uses, 'v0') THEN r.a ELSE [] END, CASE WHEN list_contains(s.uses, 'v1') THEN r.b ELSE [] END, CASE WHEN list_contains(s.uses, 'v2') THEN r.c ELSE [] END)) AS held,
   CASE WHEN s.kind = 'read' THEN [s.event_id] ELSE held END AS new FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1))
SELECT user_id, unnest(seen) AS read, condition FROM r""")
def guarded_conditions(spark, d):
    e = star.table(spark, d, "events")
    own, other = F.concat(F.lit("v"), F.col("event_id") % 3), F.concat(F.lit("v"), F.floor(F.col("event_id") / 3) % 3)
    kind = F.when(F.col("event_type") == "purchase", "read").when(F.col("event_type") == "error", "condition").otherwise("assign")
    uses = F.when(F.col("event_type") == "error", F.array(own, other)).when(F.col("event_type").isin("click", "view"), F.array(other)).when((F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0), F.array(own)).otherwise(F.array().cast("array<string>"))
    return flow.guarded(spark, e.select("user_id", "ts", "event_id", kind.alias("kind"), F.col("event_id").alias("ident"), own.alias("variable"), uses.alias("uses")), "user_id", ["ts", "event_id"])


@query("""WITH RECURSIVE i AS (SELECT o_custkey, o_orderkey AS id, date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) AS b, date_diff('day', TIMESTAMP '1970-01-01', o_orderdate) + o_orderkey % 397 AS e FROM orders),
p AS (SELECT x.o_custkey, x.id, arg_max(y.id, (y.b, -y.e, y.id)) AS parent FROM i x LEFT JOIN i y ON x.o_custkey = y.o_custkey AND (y.b, -y.e, y.id) < (x.b, -x.e, x.id) AND y.e >= x.e GROUP BY ALL),
d AS (SELECT o_custkey, id, parent, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.o_custkey, p.id, p.parent, d.depth + 1 FROM p JOIN d ON p.parent = d.id)
SELECT o_custkey, id AS o_orderkey, parent, depth FROM d""")
def nested_intervals(spark, d):
    o = star.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("b"))
    return nesting.nested(spark, o, "o_custkey", "o_orderkey", F.col("b"), F.col("b") + F.col("o_orderkey") % 397)


_OPEN = "ul|nav|div|article|footer|body|html|head|p|b|h1"


@query(rf"""WITH t AS (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^<]+') AS ts FROM pages), u AS (SELECT page_id, unnest(ts) AS tok, generate_subscripts(ts, 1) - 1 AS pos FROM t),
k AS (SELECT page_id, pos, CASE WHEN regexp_matches(tok, '^<({_OPEN})[ >]') THEN 1 WHEN regexp_matches(tok, '^</({_OPEN})>') THEN -1 ELSE 0 END AS s, regexp_matches(tok, '^<(br|li)>') AS sep FROM u),
d AS (SELECT *, sum(s) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM k),
o AS (SELECT o.page_id, o.pos AS open_at, min(c.pos) AS close_at, any_value(o.depth) - 1 AS depth FROM d o LEFT JOIN d c ON c.page_id = o.page_id AND c.pos > o.pos AND c.depth = o.depth - 1 AND c.s = -1 WHERE o.s = 1 GROUP BY ALL),
n AS (SELECT o.page_id, o.open_at, o.close_at, o.depth, count(*) FILTER (WHERE d.sep AND d.depth = o.depth + 1) AS separators, count(d.pos) AS inside FROM o LEFT JOIN d ON d.page_id = o.page_id AND d.pos > o.open_at AND d.pos < o.close_at GROUP BY ALL)
SELECT page_id, open_at, close_at, CAST(depth AS INTEGER) AS depth, CASE WHEN close_at IS NOT NULL THEN separators END AS separators, CASE WHEN close_at IS NULL THEN NULL WHEN inside = 0 THEN 0 ELSE separators + 1 END AS items FROM n""")
def bracket_pairs(spark, d):
    t = star.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<[^>]*>|[^<]+"), F.lit(0))).alias("at", "token"))
    kind = F.when(F.col("token").rlike(f"^<({_OPEN})[ >]"), "open").when(F.col("token").rlike(f"^</({_OPEN})>"), "close").when(F.col("token").rlike("^<(br|li)>"), "separator").otherwise("content")
    found = nesting.matched(t.select("page_id", "at", kind.alias("kind")), ["page_id"], "at")
    return found.withColumn("separators", F.when(F.col("close_at").isNotNull(), F.col("separators")))


_MASKED_SQL = r"""'//[^\n]*|/\*(?s:.*?)\*/|/\*(?s:.*)|"{3}(?s:.*?)"{3}|"{3}(?s:.*)|"(?:[^"\\]|\\(?s:.))*(?:"|\\?$)|''(?:[^''\\]|\\(?s:.))*(?:''|\\?$)|[^/"'']+|/'"""
_CODE = """regexp_extract(html, '<script>(.*?)</script>', 1) || ' // ' || regexp_extract(html, '<!--(.*?)-->', 1) || chr(10) || '/* ' || regexp_extract(html, '<title>(.*?)</title>', 1) || chr(10) || ' */ say(''a\\''b'', \"\"\"two' || chr(10) || '\"lines\"\"\"\") / 2; \"' || url || '\\\" // no comment\" ' || CASE WHEN page_id % 3 = 0 THEN '/* open' WHEN page_id % 3 = 1 THEN '\"open' ELSE '' END"""


@query(f"WITH c AS (SELECT page_id, {_CODE} AS code FROM pages) SELECT page_id, code, array_to_string(list_transform(regexp_extract_all(code, {_MASKED_SQL}), lambda p: CASE WHEN regexp_matches(p, '^(//|/\\*|\"|'')') THEN regexp_replace(p, '[^\\n]', ' ', 'g') ELSE p END), '') AS masked, length(code) AS size FROM c")
def masked_code(spark, d):
    part = lambda p: F.regexp_extract("html", p, 1)
    end = F.when(F.col("page_id") % 3 == 0, "/* open").when(F.col("page_id") % 3 == 1, '"open').otherwise("")
    text = F.concat(part("<script>(.*?)</script>"), F.lit(" // "), part("<!--(.*?)-->"), F.lit("\n/* "), part("<title>(.*?)</title>"), F.lit('\n */ say(\'a\\\'b\', """two\n"lines"""") / 2; "'), "url", F.lit('\\" // no comment" '), end)
    code_ = star.table(spark, d, "pages").select("page_id", text.alias("code"))
    return code_.select("page_id", "code", X.masked(F.col("code")).alias("masked"), F.char_length("code").cast("long").alias("size"))


_REPOS = """u AS (SELECT DISTINCT c_nationkey % 4 AS repo, o_custkey AS file, split_part(o_orderpriority, '-', 2) AS name FROM orders JOIN customer ON o_custkey = c_custkey), f AS (SELECT c_nationkey % 4 AS repo, c_custkey AS file, 'pkg' || c_nationkey AS package, c_custkey = 7 AS failed FROM customer),
i AS (SELECT repo, file, 'URGENT' AS name, CASE WHEN file % 2 = 0 THEN 'spring.URGENT' ELSE 'mine.URGENT' END AS target FROM f WHERE file % 5 = 0), w AS (SELECT repo, file, 'spring' AS package FROM f WHERE file % 4 < 2 UNION ALL SELECT repo, file, 'other' FROM f WHERE file % 8 = 0),
p AS (SELECT DISTINCT repo, package, 'HIGH' AS name FROM f WHERE CAST(substr(package, 4) AS INTEGER) % 3 = 0), a AS (SELECT 'spring.' || name AS qualified, name FROM (SELECT unnest(['URGENT', 'HIGH', 'MEDIUM']) AS name))"""


@query(f"""WITH {_REPOS}, q AS (SELECT u.*, (SELECT min(target) FROM i WHERE (i.repo, i.file, i.name) = (u.repo, u.file, u.name)) AS target, f.package FROM u JOIN f USING (repo, file)),
x AS (SELECT *, CASE WHEN target IS NULL AND (SELECT count(DISTINCT package) FROM w WHERE (w.repo, w.file) = (q.repo, q.file)) = 1 AND NOT (SELECT bool_or(failed) FROM f WHERE f.repo = q.repo) AND NOT EXISTS (SELECT 1 FROM p WHERE (p.repo, p.package, p.name) = (q.repo, q.package, q.name))
 THEN (SELECT min(package) FROM w WHERE (w.repo, w.file) = (q.repo, q.file)) || '.' || name END AS c FROM q), y AS (SELECT *, CASE WHEN c IN (SELECT qualified FROM a) THEN c END AS k FROM x)
SELECT repo, file, name, coalesce(target, k, package || '.' || name) AS qualified, k IS NOT NULL OR coalesce((name, target) IN (SELECT (name, qualified) FROM a), false) AS known FROM y""")
def wildcard_types(spark, d):
    o, c = star.table(spark, d, "orders"), star.table(spark, d, "customer")
    f = c.select((F.col("c_nationkey") % 4).alias("repo"), F.col("c_custkey").alias("file"), F.concat(F.lit("pkg"), "c_nationkey").alias("package"), (F.col("c_custkey") == 7).alias("failed"), "c_nationkey")
    uses = o.select(F.col("o_custkey").alias("file"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("name")).join(f.select("repo", "file"), "file")
    imports = f.filter("file % 5 = 0").select("repo", "file", F.lit("URGENT").alias("name"), F.when(F.col("file") % 2 == 0, "spring.URGENT").otherwise("mine.URGENT").alias("target"))
    wild = f.filter("file % 4 < 2").select("repo", "file", F.lit("spring").alias("package")).unionByName(f.filter("file % 8 = 0").select("repo", "file", F.lit("other").alias("package")))
    declared = f.filter("c_nationkey % 3 = 0").select("repo", "package", F.lit("HIGH").alias("name"))
    accepted = spark.createDataFrame([(n, f"spring.{n}") for n in ("URGENT", "HIGH", "MEDIUM")], "name string, qualified string")
    return merge.resolved_types(uses, f.drop("c_nationkey"), imports, wild, declared, accepted)


_PATHS = "SELECT coalesce(source, '') || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, n_chars AS bytes FROM documents"


def _paths(spark, d):
    t = star.table(spark, d, "documents")
    return t.select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.col("n_chars").alias("bytes"))


@query(f"WITH p AS ({_PATHS}) SELECT path, bytes, row_number() OVER (ORDER BY path) AS position, CAST(sum(bytes) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM p")
def running_totals(spark, d):
    return folds.running_total(spark, _paths(spark, d), ["path"], F.col("bytes"))


@query(f"""WITH p AS ({_PATHS}), t AS (SELECT path, row_number() OVER (ORDER BY path) AS position, CAST(sum(bytes) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM p)
SELECT path, position, total, CASE WHEN position > 150 THEN 'files' ELSE 'bytes' END AS over FROM t WHERE position > 150 OR total > 300000 ORDER BY position LIMIT 1""")
def repository_limits(spark, d):
    return code.over_limits(spark, _paths(spark, d), 150, 300_000)


@query(_levels("nation:3", 2000) + " SELECT h.id, coalesce(n.name, h.id) AS name, coalesce(n.type, 'Unknown') AS type, depth, via, relation, direction FROM hops h LEFT JOIN nodes n USING (id)")
def impact_stored(spark, d):
    stored = graph.Adjacency(spark, f"{shared_dir(spark)}/adjacency-{uuid.uuid4().hex}", star.edges(spark, d))
    found = graph.impact(spark, star.nodes(spark, d), stored, "nation:3", 2).drop("rank")
    stored.drop()  # the result holds its hops; a search service would keep the folder
    return found


_RULES = "r AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{r}', '{b}', {str(t in RUNTIME_SENSITIVE).lower()})" for t, (r, b) in EDGE_RULES.items()) + ") AS x(type, rule, base, sensitive))"


@query(f"""WITH {EDGES}, {_RULES}, e AS (SELECT CASE WHEN type = 'CALLS' AND length(source) % 2 = 0 THEN 'NEW_KIND' ELSE type END AS type, CASE WHEN length(target) % 3 = 0 THEN 'own.rule' WHEN length(target) % 3 = 1 THEN '' END AS rule_id, CASE WHEN length(source) % 3 = 0 THEN 'name_heuristic' END AS basis FROM edges)
SELECT e.type, coalesce(nullif(rule_id, ''), rule, 'core.' || lower(e.type)) AS rule_id, coalesce(basis, base, 'direct_syntax') AS basis, CASE WHEN sensitive THEN 'runtime_unknown' ELSE 'not_applicable' END AS runtime_status, count(*) AS n FROM e LEFT JOIN r ON r.type = e.type GROUP BY ALL""")
def edge_rules(spark, d):
    size = lambda c, k: F.char_length(c) % k
    e = star.edges(spark, d).select(
        F.when((F.col("type") == "CALLS") & (size("source", 2) == 0), "NEW_KIND").otherwise(F.col("type")).alias("type"), F.when(size("target", 3) == 0, "own.rule").when(size("target", 3) == 1, "").alias("rule_id"),
        F.when(size("source", 3) == 0, "name_heuristic").alias("basis"), F.lit(None).cast("string").alias("runtime_status"),
    )
    return projections.with_rules(e).groupBy("type", "rule_id", "basis", "runtime_status").agg(F.count("*").alias("n"))


_ADAPTERS = """a AS (SELECT p_partkey AS scope, ['Java', 'Python', 'Rust'][p_size % 3 + 1] AS language, ['supported', 'partial', 'odd', ' unsupported '][p_partkey % 4 + 1] AS status, CASE WHEN p_size % 2 = 0 THEN true END AS detected, p_size, p_partkey FROM part),
g AS (SELECT scope, language, trim(status) AS status, coalesce(detected, false) AS detected, CASE WHEN p_size % 5 = 0 THEN [] WHEN p_partkey % 2 = 0 THEN ['calls=partial', 'imports=supported'] ELSE ['calls=partial'] END AS caps, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE ['runtime.k' || (p_partkey % 9), 'java.proxy'] END AS odd FROM a WHERE language <> 'Rust' AND status <> 'odd')"""


def _adapters(spark, d):
    pick = lambda values, key, k: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % k + 1).cast("int"))
    imports = F.when(F.col("p_partkey") % 2 == 0, "supported").otherwise("maybe")
    caps = F.when(F.col("p_size") % 5 != 0, F.create_map(F.lit("imports"), imports, F.lit("calls"), F.lit("partial"), F.lit("telepathy"), F.lit("supported")))
    odd = F.when(F.col("p_partkey") % 7 != 0, F.array(F.concat(F.lit("runtime.k"), F.col("p_partkey") % 9), F.lit("Bad Rule"), F.lit("java.proxy"), F.lit("/etc/passwd")))
    return star.table(spark, d, "part").select(F.col("p_partkey").alias("scope"), pick(("Java", "Python", "Rust"), "p_size", 3).alias("language"), pick(("supported", "partial", "odd", " unsupported "), "p_partkey", 4).alias("status"), F.when(F.col("p_size") % 2 == 0, True).alias("detected"), caps.alias("capabilities"), odd.alias("unsupported_runtime"))


@query(f"WITH {_ADAPTERS} SELECT scope, language, status, detected, array_to_string(caps, ',') AS capabilities, array_to_string(odd, ',') AS unsupported FROM g")
def adapter_projection(spark, d):
    caps = F.array_sort(F.transform(F.map_entries("capabilities"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return projections.api_adapters(_adapters(spark, d)).select("scope", "language", "status", "detected", F.array_join(caps, ",").alias("capabilities"), F.array_join("unsupportedRuntime", ",").alias("unsupported"))


_REPORTS = """q AS (SELECT p_partkey AS scope, CASE WHEN p_size % 3 = 0 THEN '1.0' END AS c, CASE WHEN p_size % 4 = 0 THEN 'documented' WHEN p_size % 4 = 1 THEN 'odd' END AS s, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 7000 END AS t1, p_partkey * 3 AS t2, p_partkey * 5000 AS dd, p_size - 10 AS m, p_retailprice / 7 AS p FROM part),
k AS (SELECT scope, CASE WHEN s = 'documented' OR c IS NOT NULL THEN 'documented' ELSE 'legacy_unknown' END AS status, c, CAST(least(greatest(coalesce(t1, t2), 0), 1000000) AS BIGINT) AS t, dd, m, p FROM q),
z AS (SELECT scope, status, coalesce(c, CASE WHEN status = 'legacy_unknown' THEN 'legacy_unknown' ELSE 'unknown' END) AS contractVersion, t AS totalEdges, least(least(dd, 1000000), t) AS documentedEdges, CAST(least(greatest(m, 0), t) AS BIGINT) AS missingEvidence, round(least(greatest(p, 0), 100), 2) AS coveragePercent FROM k)"""


def _reports(spark, d):
    p = star.table(spark, d, "part")
    legacy = F.struct((F.col("p_partkey") * 3).alias("total_edges"), (F.col("p_partkey") * 5000).alias("documented_edges"), (F.col("p_size") - 10).cast("bigint").alias("missing_evidence"), (F.col("p_retailprice") / 7).alias("coverage_percent"))
    raw = p.select(F.col("p_partkey").alias("scope"), F.when(F.col("p_size") % 3 == 0, "1.0").alias("contract_version"), F.when(F.col("p_size") % 4 == 0, "documented").when(F.col("p_size") % 4 == 1, "odd").alias("status"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") * 7000).alias("totalEdges"), legacy.alias("relationship_evidence"))
    return projections.api_quality(raw)


@query(f"WITH {_REPORTS} SELECT * FROM z")
def quality_projection(spark, d):
    return _reports(spark, d)


@query(f"""WITH {_REPORTS}, {_ADAPTERS}, n AS (SELECT scope, '<urn:graph:quality:' || sha256('{{"scope":"' || scope || '","contractVersion":"' || contractVersion || '","documentedEdges":' || documentedEdges || ',"missingEvidence":' || missingEvidence || ',"coveragePercent":' || coveragePercent || '}}') AS i, contractVersion AS c, documentedEdges AS dd, missingEvidence AS m, coveragePercent AS p FROM z),
b AS (SELECT g.*, i || '>' AS q, replace(i, 'quality:', 'adapter-quality:') || ':' || language || '>' AS x FROM g JOIN n USING (scope)),
l AS (SELECT i || '> a <urn:graph:OntologyQuality> .' AS line FROM n UNION ALL SELECT i || '> <urn:graph:contractVersion> "' || c || '" .' FROM n UNION ALL SELECT i || '> <urn:graph:documentedEdges> "' || dd || '"^^xsd:integer .' FROM n UNION ALL SELECT i || '> <urn:graph:missingEvidence> "' || m || '"^^xsd:integer .' FROM n
 UNION ALL SELECT i || '> <urn:graph:coveragePercent> "' || p || '"^^xsd:decimal .' FROM n UNION ALL SELECT x || ' a <urn:graph:AdapterQuality> .' FROM b UNION ALL SELECT x || ' <urn:graph:language> "' || language || '" .' FROM b UNION ALL SELECT x || ' <urn:graph:supportStatus> "' || status || '" .' FROM b
 UNION ALL SELECT x || ' <urn:graph:detected> "' || detected || '"^^xsd:boolean .' FROM b UNION ALL SELECT x || ' <urn:graph:capability> "' || unnest(caps) || '" .' FROM b UNION ALL SELECT x || ' <urn:graph:unsupportedRuntime> "' || unnest(odd) || '" .' FROM b UNION ALL SELECT q || ' <urn:graph:hasAdapterQuality> ' || x || ' .' FROM b)
SELECT DISTINCT line FROM l""")
def turtle_quality(spark, d):
    return projections.quality_triples(_reports(spark, d), projections.api_adapters(_adapters(spark, d)))
