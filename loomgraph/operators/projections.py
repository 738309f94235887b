"""What leaves the engine: nodes, evidence, statistics and quality, bounded and cleaned, as Column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import api_path, bounded_number, bounded_text, clamp, percent_encode, portable_path, predicate_name, rule_id, turtle_literal
from loomgraph.schemas import BASES, CAPABILITIES, EDGE_RULES, MOST_EVIDENCE, MOST_LIMITATIONS, MOST_PATH, MOST_UNSUPPORTED, NOT_OBSERVED, RUNTIME_SENSITIVE, RUNTIME_STATUSES, SUPPORT

MOST_LINE = 10_000_000
LANGUAGES = ["Java", "Python"]


def node_summary(nodes: DataFrame) -> DataFrame:
    """Identity and place of a node, without metadata."""
    return nodes.select("id", "name", "type", "language", "path", F.col("qualified_name").alias("qualifiedName"))


def portable_node(nodes: DataFrame) -> DataFrame:
    """A summary with the metadata that may leave, and only portable paths. Line spans stay behind."""
    path = F.when(portable_path(F.col("path")), F.translate("path", "\\", "/"))
    return nodes.select("id", "type", "name", "language", path.alias("path"), "qualified_name", F.struct("metadata.return_type", "metadata.semantic_groups", "metadata.ordinal").alias("metadata"))


def api_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as the API gives them; those whose id, name, type or language is empty or unsafe are left out."""
    text = {"id": 1000, "name": 500, "type": 100, "language": 100}
    groups = F.filter(F.transform(F.slice("metadata.semantic_groups", 1, 20), lambda g: bounded_text(g, 100)), lambda g: g.isNotNull())
    out = nodes.select(
        *[bounded_text(F.col(c), most).alias(c) for c, most in text.items()], bounded_text(F.col("qualified_name"), 1000).alias("qualifiedName"), api_path(F.col("path")).alias("path"),
        bounded_text(F.col("metadata.return_type"), 500).alias("returnType"), groups.alias("semanticGroups"),
        F.when(F.col("metadata.ordinal").isNotNull(), clamp(F.col("metadata.ordinal"), 1_000_000)).alias("ordinal"),
    )
    return out.dropna(subset=[*text])


def clean_evidence(items: Column, most: int = MOST_EVIDENCE) -> Column:
    """An edge's first items, without those whose rule, basis or status is not allowed; paths that are not portable and impossible lines are dropped, limitations
    checked, sorted and made distinct."""

    def clean(e: Column) -> Column:
        line = F.when(e["line_start"] >= 1, e["line_start"])
        allowed = F.array_sort(F.array_distinct(F.filter(F.slice(e["limitations"], 1, 2 * MOST_LIMITATIONS), rule_id)))
        return F.struct(
            e["rule_id"].alias("rule_id"), e["basis"].alias("basis"), e["runtime_status"].alias("runtime_status"),
            F.when(portable_path(e["path"]), F.translate(e["path"], "\\", "/")).alias("path"), line.alias("line_start"),
            F.when(line.isNotNull(), F.greatest(line, F.coalesce(e["line_end"], line))).alias("line_end"), F.when(F.size(allowed) > 0, allowed).alias("limitations"),
        )

    fine = lambda e: rule_id(e["rule_id"]) & F.coalesce(e["basis"].isin(BASES), F.lit(False)) & F.coalesce(e["runtime_status"].isin(RUNTIME_STATUSES), F.lit(False))
    return F.transform(F.filter(F.slice(items, 1, most), fine), clean)


def api_evidence(items: Column) -> Column:
    """Evidence as the API gives it: its own names, paths with forward slashes only, lines up to a bound."""

    def clean(e: Column) -> Column:
        line = clamp(e["line_start"], MOST_LINE)
        end = clamp(e["line_end"], MOST_LINE)
        limits = F.filter(F.transform(F.slice(e["limitations"], 1, MOST_LIMITATIONS), lambda t: bounded_text(t, 200)), lambda t: t.isNotNull())
        return F.struct(
            e["rule_id"].alias("ruleId"), e["basis"].alias("basis"), e["runtime_status"].alias("runtimeStatus"), api_path(e["path"], MOST_PATH).alias("path"),
            F.when(line >= 1, line).alias("lineStart"), F.when(line >= 1, F.greatest(line, F.when(end > 0, end).otherwise(line))).alias("lineEnd"), F.when(F.size(limits) > 0, limits).alias("limitations"),
        )

    return F.transform(F.filter(F.slice(items, 1, MOST_EVIDENCE), lambda e: rule_id(e["rule_id"]) & e["basis"].isin(BASES) & e["runtime_status"].isin(RUNTIME_STATUSES)), clean)


def with_required_limitation(limitations: Column, status: Column, most: int = MOST_LIMITATIONS) -> Column:
    """Sorted, distinct, bounded limitations; what was not observed at run time must say so, in place of the last if there is no room."""
    own = F.array_sort(F.array_distinct(F.filter(F.coalesce(limitations, F.array().cast("array<string>")), rule_id)))
    said = F.array_sort(F.array_union(own, F.array(F.lit(NOT_OBSERVED))))
    room = F.slice(said, 1, most)
    forced = F.array_sort(F.concat(F.slice(said, 1, most - 1), F.array(F.lit(NOT_OBSERVED))))
    return F.when(status == "runtime_unknown", F.when(F.array_contains(room, NOT_OBSERVED), room).otherwise(forced)).otherwise(F.slice(own, 1, most))


def evidence_card(items: Column, shown: int = 12) -> Column:
    """What an edge's card shows of its evidence: the first items, how many more there are, and the first of all limitations."""
    limits = F.array_sort(F.array_distinct(F.flatten(F.transform(items, lambda e: F.coalesce(e["limitations"], F.array().cast("array<string>"))))))
    return F.struct(F.slice(items, 1, shown).alias("items"), F.greatest(F.size(items) - shown, F.lit(0)).alias("more"), F.slice(limits, 1, shown).alias("limitations"))


def reified(edges: DataFrame) -> DataFrame:
    """Evidence as statements about statements: lines of Turtle whose subject is named by the digest of the item and its edge. What the digest is made of is made distinct, as short columns, before lines are
    written: lines of one item differ in their predicate and those of two items in their subject, so no line comes twice and no line is moved."""
    iri = lambda kind, x: F.concat(F.lit(f"<urn:{kind}:"), x, F.lit(">"))
    e = edges.select("source", "target", "type", F.explode("evidence").alias("e")).select("source", "target", "type", F.struct("e.basis", "e.rule_id", "e.runtime_status").alias("e")).distinct()
    canon = F.to_json(F.struct("e.basis", "e.rule_id", "e.runtime_status", "source", "target", "type"))
    own = iri("evidence", F.sha2(canon, 256))
    said = [
        ("a", F.lit("rdf:Statement")), ("rdf:subject", iri("node", percent_encode(F.col("source")))), ("rdf:predicate", iri("graph", predicate_name(F.col("type")))), ("rdf:object", iri("node", percent_encode(F.col("target")))),
        ("<urn:graph:ruleId>", turtle_literal(F.col("e.rule_id"))), ("<urn:graph:evidenceBasis>", turtle_literal(F.col("e.basis"))), ("<urn:graph:runtimeStatus>", turtle_literal(F.col("e.runtime_status"))),
    ]
    return e.select(F.explode(F.array(*[F.concat_ws(" ", own, F.lit(p), v, F.lit(".")) for p, v in said])).alias("line"))


def contract_errors(edges: DataFrame, required: bool = True) -> DataFrame:
    """Violations of the evidence contract, by edge and kind: no evidence, too many items, a rule, basis or status that is not allowed, a path that is not portable,
    lines that come alone or in the wrong order, limitations out of order, repeated or too many, and a missing required one."""
    items, none = F.col("evidence"), F.array().cast("array<string>")

    def kinds(e: Column) -> Column:
        limits = F.coalesce(e["limitations"], none)
        start, end = e["line_start"], e["line_end"]
        wrong = {
            "rule": ~rule_id(e["rule_id"]), "basis": ~F.coalesce(e["basis"].isin(BASES), F.lit(False)), "status": ~F.coalesce(e["runtime_status"].isin(RUNTIME_STATUSES), F.lit(False)),
            "path": e["path"].isNotNull() & ~portable_path(e["path"]), "lines": (start.isNull() != end.isNull()) | F.coalesce((start < 1) | (end < start) | (end > MOST_LINE), F.lit(False)),
            "limitations": (F.size(limits) > MOST_LIMITATIONS) | (limits != F.array_sort(F.array_distinct(limits))) | F.exists(limits, lambda x: ~rule_id(x)),
            "required limitation": F.coalesce(e["runtime_status"] == "runtime_unknown", F.lit(False)) & ~F.array_contains(limits, NOT_OBSERVED),
        }
        return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in wrong.items()]))

    count = F.coalesce(F.size(items), F.lit(0))
    whole = F.array_compact(F.array(F.when((count < 1) & F.lit(required), F.lit("no evidence")), F.when(count > MOST_EVIDENCE, F.lit("too many items"))))
    found = F.concat(whole, F.coalesce(F.flatten(F.transform(items, kinds)), none))
    return edges.select("source", "target", "type", F.explode(found).alias("error"))


def rounded(x: Column, digits: int) -> Column:
    """A number that is not negative, rounded as SQL engines round doubles: halves of its binary value go up. (Spark's round takes the halves of its decimal text: 1.005 gives 1.01 there.)"""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def evidence_statistics(edges: DataFrame) -> DataFrame:
    """One row: edges, documented ones, those without, those with a span of lines, and both shares in per cent (100 without edges)."""
    spans = F.exists("evidence", lambda e: e["line_start"].isNotNull())
    c = edges.select((F.size("evidence") > 0).alias("has"), F.coalesce(spans, F.lit(False)).alias("span")).agg(F.count("*").alias("total_edges"), F.count_if("has").alias("documented_edges"), F.count_if(F.coalesce(~F.col("has"), F.lit(True))).alias("missing_evidence"), F.count_if("span").alias("source_span_edges"))
    share = lambda x: F.when(F.col("total_edges") == 0, 100.0).otherwise(rounded(100.0 * F.col(x) / F.col("total_edges"), 3))
    return c.select("*", share("documented_edges").alias("coverage_percent"), share("source_span_edges").alias("source_span_coverage_percent"))


def quality_summary(statistics: DataFrame, most_edges: int | None = 1_000_000) -> DataFrame:
    """Statistics and their compact summary: counts clamped (from below only, without most_edges), documented ones never above the total, and shares from 0 to 100."""
    count = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0))) if most_edges is None else clamp(F.col(c), most_edges)
    total = count("total_edges")
    documented = F.least(count("documented_edges"), total)
    return statistics.select("*", F.lit("1.0").alias("contractVersion"), total.alias("totalEdges"), documented.alias("documentedEdges"), (total - documented).alias("missingEvidence"), rounded(F.greatest(F.lit(0.0), F.least("coverage_percent", F.lit(100.0))), 2).alias("coveragePercent"))


def mapping_total(x: Column, allowed: list[str], most: int) -> Column:
    """The sum of a map's positive numbers under allowed keys, at most so much."""
    good = F.map_values(F.map_filter(x, lambda k, v: k.isin(allowed) & (v > 0)))
    return F.least(F.coalesce(F.aggregate(good, F.lit(0).cast("bigint"), lambda a, v: a + v), F.lit(0)), F.lit(most))


def adapters(files: DataFrame) -> DataFrame:
    """Both languages, always, with their number of files and whether they were detected."""
    known = files.sparkSession.createDataFrame([(x,) for x in LANGUAGES], "language string")
    found = files.filter(F.col("language").isin(LANGUAGES)).groupBy("language").agg(F.count("*").alias("n"))
    return known.join(found, "language", "left").select("language", F.coalesce("n", F.lit(0)).alias("files"), F.col("n").isNotNull().alias("detected"))


def holds_policy(nodes: DataFrame) -> DataFrame:
    """Whether the graph tells of policies."""
    return nodes.agg(F.coalesce(F.bool_or(F.col("type") == "PolicyLeaf"), F.lit(False)).alias("policy_paths"))


def grouped_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as groups that can be read: nodes by type and edges by relation, largest first."""
    count = lambda df, kind: df.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
    return count(nodes, "node").unionByName(count(edges, "edge")).orderBy("kind", F.desc("n"), "label")


def edge_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by the names of their ends: the qualified name, else the name, else the id."""
    label = F.coalesce(F.when(F.col("qualified_name") != "", F.col("qualified_name")), F.when(F.col("name") != "", F.col("name")))
    names = nodes.select("id", label.alias("label"))
    s, t = names.select(F.col("id").alias("source"), F.col("label").alias("s")), names.select(F.col("id").alias("target"), F.col("label").alias("t"))
    # the id of an end is left behind where its label is known, so it is not moved on
    named = edges.select("source", "target", "type").join(s, "source", "left").select(F.coalesce("s", "source").alias("source_label"), "target", "type")
    return named.join(t, "target", "left").select("source_label", F.coalesce("t", "target").alias("target_label"), "type").distinct()


def metrics(cases: DataFrame, *by: str) -> DataFrame:
    """Precision and recall of (tp, fp, fn), summed by group; 1 where there is nothing to divide by."""
    c = cases.groupBy(*by).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    rate = lambda b: F.when(F.col("tp") + F.col(b) == 0, 1.0).otherwise(F.round(F.col("tp") / (F.col("tp") + F.col(b)), 6))
    return c.select("*", rate("fp").alias("precision"), rate("fn").alias("recall"))


def evaluate_case(found: DataFrame, required: DataFrame, forbidden: DataFrame, keys: list[str]) -> DataFrame:
    """One row: required items that were found (tp), forbidden ones that were (fp), required ones that were not (fn)."""
    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(1))
    parts = [mark(found, "f"), mark(required, "r"), mark(forbidden, "x")]
    tagged = parts[0].unionByName(parts[1], True).unionByName(parts[2], True).groupBy(*keys).agg(*[F.max(c).isNotNull().alias(c) for c in "frx"])
    return tagged.agg(F.count_if(F.col("r") & F.col("f")).alias("tp"), F.count_if(F.col("x") & F.col("f")).alias("fp"), F.count_if(F.col("r") & ~F.col("f")).alias("fn"))


def with_rules(edges: DataFrame) -> DataFrame:
    """Edges (type, rule_id, basis, runtime_status; each may be null) with what the rule catalogue says where they say nothing. The catalogue is a table of a row for each relation, at most as many as
    there are relations, so it is sent to all tasks. Relations that it doesn't hold get the rule core.<type> and direct syntax; the status depends on whether the relation is sensitive to run time."""
    catalogue = edges.sparkSession.createDataFrame([(t, r, b, t in RUNTIME_SENSITIVE) for t, (r, b) in EDGE_RULES.items()], "type string, __rule string, __basis string, __sensitive boolean")
    joined = edges.join(F.broadcast(catalogue), "type", "left")
    said = {
        "rule_id": F.coalesce(F.nullif("rule_id", F.lit("")), "__rule", F.concat(F.lit("core."), F.lower("type"))), "basis": F.coalesce(F.nullif("basis", F.lit("")), "__basis", F.lit("direct_syntax")),
        "runtime_status": F.coalesce(F.nullif("runtime_status", F.lit("")), F.when(F.coalesce("__sensitive", F.lit(False)), "runtime_unknown").otherwise("not_applicable")),
    }
    return joined.withColumns(said).select(*edges.columns)


def api_adapters(adapters: DataFrame) -> DataFrame:
    """Adapters (language, status, detected, capabilities as a map, unsupported_runtime as a list) as the API gives them: the known languages with a known status, known capabilities with a
    known status, and the well-formed of the first MOST_UNSUPPORTED things that they don't support. An adapter that says nothing of detected was not detected."""
    status = bounded_text(F.col("status"), 30)
    known = F.map_filter("capabilities", lambda k, v: k.isin(CAPABILITIES) & F.coalesce(bounded_text(v, 30).isin(SUPPORT), F.lit(False)))
    odd = F.filter(F.transform(F.slice("unsupported_runtime", 1, MOST_UNSUPPORTED), lambda x: bounded_text(x, 80)), lambda x: rule_id(x))
    none = F.create_map().cast("map<string,string>")
    own = [c for c in adapters.columns if c not in ("language", "status", "detected", "capabilities", "unsupported_runtime")]
    return adapters.filter(F.col("language").isin(LANGUAGES)).select(
        *own, "language", status.alias("status"), F.coalesce("detected", F.lit(False)).alias("detected"), F.coalesce(known, none).alias("capabilities"), F.coalesce(odd, F.array().cast("array<string>")).alias("unsupportedRuntime"),
    ).filter(F.col("status").isin(SUPPORT))


def api_quality(raw: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Quality reports as the API gives them. Fields may come in either spelling (contractVersion before contract_version, totalEdges before relationship_evidence.total_edges, and so on); counts lie between 0 and most
    and those of edges never above the total, the share between 0 and 100; a report that says nothing of its contract is a legacy one."""
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None)
    nested = lambda c: F.col(f"relationship_evidence.{c}") if "relationship_evidence" in raw.columns else F.lit(None)
    count = lambda camel, snake: clamp(F.coalesce(has(camel), nested(snake)).cast("bigint"), most)
    contract = F.coalesce(has("contractVersion"), has("contract_version")).cast("string")
    status = F.when(has("status").isin("documented", "legacy_unknown"), has("status")).when(contract.isNotNull(), "documented").otherwise("legacy_unknown")
    total = count("totalEdges", "total_edges")
    own = [c for c in raw.columns if c not in ("contractVersion", "contract_version", "status", "totalEdges", "documentedEdges", "missingEvidence", "coveragePercent", "relationship_evidence")]
    return raw.select(
        *own, status.alias("status"), F.coalesce(bounded_text(contract, 50), F.when(status == "legacy_unknown", "legacy_unknown").otherwise("unknown")).alias("contractVersion"), total.alias("totalEdges"),
        F.least(count("documentedEdges", "documented_edges"), total).alias("documentedEdges"), F.least(count("missingEvidence", "missing_evidence"), total).alias("missingEvidence"),
        bounded_number(F.coalesce(has("coveragePercent"), nested("coverage_percent")).cast("double"), 100.0).alias("coveragePercent"),
    )


def quality_triples(quality: DataFrame, adapters: DataFrame, space: str = "urn:graph:") -> DataFrame:
    """Lines of Turtle for reports (scope, contractVersion, documentedEdges, missingEvidence, coveragePercent) and for the adapters (scope, and the columns of api_adapters) that belong to them. A report is
    named by the digest of its scope and numbers, an adapter by that and its language. Both are dealt by scope and made distinct as short columns; lines are written last, differ then, and are not moved."""
    numbers = ["contractVersion", "documentedEdges", "missingEvidence", "coveragePercent"]
    digest = F.sha2(F.to_json(F.struct(F.col("scope").cast("string").alias("scope"), *numbers)), 256)
    dealt = int(quality.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said here, as small partitions joined up would make large tasks of short rows
    q = quality.select("scope", *numbers).repartition(dealt, "scope").distinct().withColumn("digest", digest)
    iri = lambda kind, x: F.concat(F.lit(f"<{space}{kind}:"), x, F.lit(">"))
    typed = lambda x, kind: F.concat(F.lit('"'), x.cast("string"), F.lit(f'"^^xsd:{kind}'))
    line = lambda s, p, o: F.concat_ws(" ", s, p, o, F.lit("."))
    own = iri("quality", F.col("digest"))
    about = [("a", F.lit(f"<{space}OntologyQuality>")), (f"<{space}contractVersion>", turtle_literal(F.col("contractVersion"))), (f"<{space}documentedEdges>", typed(F.col("documentedEdges"), "integer")), (f"<{space}missingEvidence>", typed(F.col("missingEvidence"), "integer")), (f"<{space}coveragePercent>", typed(F.col("coveragePercent"), "decimal"))]
    reports = q.select(F.explode(F.array(*[line(own, F.lit(p), o) for p, o in about])).alias("line"))
    say = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    said = [say("a", F.lit(f"<{space}AdapterQuality>")), say(f"<{space}language>", turtle_literal(F.col("language"))), say(f"<{space}supportStatus>", turtle_literal(F.col("status"))), say(f"<{space}detected>", typed(F.col("detected"), "boolean"))]
    able = F.transform(F.map_entries("capabilities"), lambda e: say(f"<{space}capability>", turtle_literal(F.concat_ws("=", e["key"], e["value"]))))
    odd = F.transform("unsupportedRuntime", lambda x: say(f"<{space}unsupportedRuntime>", turtle_literal(x)))
    # the line that ties an adapter to its report begins with the report, so it has no predicate of its own here
    facts = F.concat(F.array(*said), able, odd, F.array(F.struct(F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("o"))))
    a = adapters.repartition(dealt, "scope").select("scope", "language", F.inline(facts)).distinct()
    adapter = iri("adapter-quality", F.concat("digest", F.lit(":"), percent_encode(F.col("language"))))
    tie = line(own, F.lit(f"<{space}hasAdapterQuality>"), adapter)
    lines = a.join(q.select("scope", "digest"), "scope").select(F.when(F.col("p").isNull(), tie).otherwise(line(adapter, F.col("p"), F.col("o"))).alias("line"))
    return reports.unionByName(lines)
