"""Findings of a review: each test failed before its finding was settled."""

import random

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.llm import substring_dedup
from loomgraph.operators import graph, merge, nesting, projections
from loomgraph.plans import registry


def above(df, node):
    """The optimized plan, from the root down to the first line that names the node."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return "\n".join(lines[: next(i for i, x in enumerate(lines) if node in x)])


def test_items_are_made_distinct_before_lines_are_written(spark):
    item = ("a.rule", "direct_syntax", "not_applicable")
    rows = [("n:1", "n:2", "CALLS", [item, ("b.rule", *item[1:]), item]), ("n:1", "n:2", "CALLS", [item]), ("n:1", "n:3", "CALLS", [item])]
    edges = spark.createDataFrame(rows, "source string, target string, type string, evidence array<struct<rule_id:string,basis:string,runtime_status:string>>")
    lines = projections.reified(edges)
    assert "Aggregate" not in above(lines, "Generate")
    found = [r.line for r in lines.collect()]
    assert len(found) == len(set(found)) == 3 * 7


def test_evidence_spans_of_over_a_million_edges(spark, tmp_path):
    n = 1_200_000
    rows = spark.range(n).select((F.col("id") % 1000).alias("l_orderkey"), F.lit(1).alias("l_partkey"), F.lit(2).alias("l_linenumber"), F.when(F.col("id") % 8 == 0, 1.0).otherwise(10.0).alias("l_quantity"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    ours = registry.queries()["evidence_spans"](spark, str(tmp_path)).first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert tuple(ours) == con.execute(registry.oracle_sql()["evidence_spans"]).fetchone()
    assert ours["totalEdges"] == n


def test_shares_are_rounded_as_the_sql_rounds(spark):
    values = [k / 1000 for k in range(5, 100_000, 10)]
    ours = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(projections.rounded(F.col("v"), 2).alias("x")).collect()]
    theirs = [x for (x,) in duckdb.connect().execute("SELECT round(v, 2) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
    assert ours == theirs


def test_reports_and_adapters_are_made_distinct_before_lines_are_written(spark):
    quality = spark.createDataFrame([(1, "1.0", 5, 0, 99.5)] * 2 + [(1, "1.0", 6, 0, 99.5), (2, "1.0", 5, 0, 99.5)], "scope int, contractVersion string, documentedEdges bigint, missingEvidence bigint, coveragePercent double")
    rows = [(1, "Java", "partial", True, {"calls": "partial"}, ["java.proxy"]), (1, "Java", "partial", True, {"calls": "partial"}, []), (1, "Java", "supported", False, {}, ["java.proxy", "java.proxy"]), (3, "Java", "partial", True, {}, [])]
    adapters = spark.createDataFrame(rows, "scope int, language string, status string, detected boolean, capabilities map<string,string>, unsupportedRuntime array<string>")
    lines = projections.quality_triples(quality, adapters)
    assert "Aggregate" not in above(lines, "Union")
    found = [r.line for r in lines.collect()]
    # three reports of five lines; two of them with an adapter of two statuses, two detections and one of each other kind
    assert len(found) == len(set(found)) == 3 * 5 + 2 * (1 + 1 + 2 + 2 + 1 + 1 + 1)


def exchanged(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_grouped_relations_move_rows_once_and_deal_hubs(spark):
    rows = [("hub", f"n{i % 3000}", "CALLS") for i in range(6000)] + [(f"n{i}", f"m{i % 7}", "READS") for i in range(500)] + [("a", "a", "CALLS")] * 2
    edges = spark.createDataFrame(rows, "source string, target string, type string")
    found = graph.grouped_relations(edges, 5)
    assert exchanged(found) == 3  # the others once; hubs by part, then by group
    want = {}
    for s, t, kind in set(rows):
        want.setdefault((s, "outgoing", kind), []).append(t)
        want.setdefault((t, "incoming", kind), []).append(s)
    got = {(r.node, r.direction, r.type): (r.n, r["first"]) for r in found.collect()}
    assert got == {k: (len(v), sorted(v)[:5]) for k, v in want.items()}
    assert exchanged(graph.grouped_relations(edges.filter("source <> 'hub' and type <> 'READS'"), 5)) == 1


def test_types_are_not_dealt_by_keys_of_few_values(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    uses = table([(r, f, n) for r in (1, 2) for f in range(4) for n in ("A", "B", "C")] * 2 + [(3, 9, "A"), (1, 0, None)], "repo int, file int, name string")
    files = table([(r, f, "p" if f % 2 else "q", (r, f) == (2, 3)) for r in (1, 2) for f in range(4)], "repo int, file int, package string, failed boolean")
    imports = table([(1, 0, "A", "x.A"), (1, 0, "A", "w.A"), (1, 1, "B", "w.B")], "repo int, file int, name string, target string")
    wild = table([(1, 0, "w"), (1, 1, "w"), (1, 2, "w"), (1, 2, "v"), (1, 3, "w"), (2, 0, "w"), (3, 9, "w")], "repo int, file int, package string")
    declared, accepted = table([(1, "p", "A")] * 3, "repo int, package string, name string"), table([("A", "w.A"), ("B", "w.B")], "name string, qualified string")
    found = merge.resolved_types(uses, files, imports, wild, declared, accepted)
    dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert sum("BroadcastHashJoin" in x for x in dealt) >= 3
    got = {(r.repo, r.file, r.name): (r.qualified, r.known) for r in found.collect()}
    want = {(r, f, n): (("p" if f % 2 else "q") + f".{n}", False) for r in (1, 2) for f in range(4) for n in ("A", "B", "C")} | {(3, 9, "A"): ("A", False), (1, 0, None): ("q", False)}
    want |= {(1, 0, "A"): ("w.A", True), (1, 0, "B"): ("w.B", True), (1, 1, "B"): ("w.B", True), (1, 3, "B"): ("w.B", True)}
    assert got == want


def crowded_texts():
    """Pairs of texts with a passage of similarity 0.82, two thirds of which are a fragment that 60 unlike texts (before and after them) have as well; and where all pairs can be confirmed."""
    rng = random.Random(3)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    fragment, rows, pairs = some(40), [], []
    put = lambda words: rows.append((len(rows), " ".join(some(60) + words + some(60)))) or len(rows) - 1
    for _ in range(30):
        put(fragment)
    for _ in range(25):
        end = some(14)
        pairs.append((put(fragment + some(1) + end), put(fragment + some(1) + end)))
    for _ in range(30):
        put(fragment)
    return rows, pairs


def test_crowded_signatures_hide_no_similar_passage(spark, monkeypatch):
    rows, pairs = crowded_texts()
    hashes = [substring_dedup.sequences([t.encode()]) for _, t in rows]
    brute = {(i, j) for j in range(len(rows)) for i in range(j) if substring_dedup.confirm(hashes[j][0][: hashes[j][2][0]], hashes[i][0][: hashes[i][2][0]])}
    assert brute == set(pairs)
    monkeypatch.setattr(substring_dedup, "BLOCK", 16)  # several blocks, each with several tables
    monkeypatch.setattr(substring_dedup, "BESIDE", 5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in substring_dedup.substring_duplicates(spark, docs).collect()}
    want = {i: (i, 0) for i, _ in rows} | {x: (a, 1) for a, b in pairs for x in (a, b)}
    assert {i: x for i, x in got.items() if x != want[i]} == {}


def test_what_is_not_laid_side_by_side_can_not_be_confirmed():
    """Surroundings of one centre, with one to three differences or an insertion on either side: every pair that can be confirmed is met."""
    rng = np.random.default_rng(5)
    middle, n = 300, 601
    whole = rng.integers(1 << 33, 1 << 62, n).astype(np.uint64)
    rows = []
    for _ in range(120):
        left, right = rng.integers(0, 90, 2)
        x = rng.integers(1 << 33, 1 << 62, n).astype(np.uint64)
        x[middle - left : middle + right + 1] = whole[middle - left : middle + right + 1]
        for at in rng.integers(-80, 80, rng.integers(0, 4)):
            if at > 0 or at < -5:
                x[middle + at : middle + at + 5] = rng.integers(1 << 33, 1 << 62, 5).astype(np.uint64)
        rows.append(x)
    near = np.stack([(x[middle - substring_dedup.REACH : middle + substring_dedup.REACH + 1] >> np.uint64(32)).astype(np.uint32) for x in rows])
    labels = np.arange(len(rows))
    met = {(int(i), int(j)) for a, b in substring_dedup.meetings(near, near, labels, labels, True) for i, j in zip(a, b)}
    through = lambda p: p[0] <= middle <= p[1] and p[2] <= middle <= p[3]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if any(through(p) and p[1] - p[0] < 2 * substring_dedup.LEAST - 1 for p in substring_dedup.confirm(rows[i], rows[j]))}
    assert want and want <= met and len(met) < len(rows) * (len(rows) - 1) // 2


def test_a_short_line_brings_no_texts_together_and_an_anchor_does(spark):
    """Of texts with one line of 13 words in common none share a key, so nothing grows with their square; of two with a passage with one or two breaks, both have one of its anchors."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line, passage = some(13), some(90)
    texts = [some(70) + line + some(70) for _ in range(40)]
    for broken in ([22], [44], [30, 60], [20, 45]):
        texts.append(some(70) + [x + "x" * (k in broken) for k, x in enumerate(passage)] + some(70))
    whole = len(texts)
    texts.append(some(70) + passage + some(70))
    spots = [[{"sig": 1, "lc": (70 + 4), "rh": (len(x) - substring_dedup.SHINGLE) << 32}] for x in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([" ".join(x) for x in texts]), pa.array(range(len(texts)), pa.int64()), pa.array(spots)], names=["__row", "text", "label", "spots"])
    keys = {}
    for out in substring_dedup.emit_anchors(iter([batch])):
        for key, row in zip(out["sig"].to_pylist(), out["row"].to_pylist()):
            keys.setdefault(row, set()).add(key)
    assert not any(keys[i] & keys[j] for i in range(40) for j in range(i))
    assert all(keys[i] & keys[whole] for i in range(40, whole))


def test_crowded_texts_without_a_long_run_in_common_are_met(spark):
    """Two texts with the same 9 lines of 13 words in another order: all shingles alike, but no run of 10, and each line is in 12 other texts as well, so that every signature is crowded."""
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    hinge, lines = some(4), [some(5) for _ in range(9)]
    joined = lambda order: hinge + [w for k in order for w in lines[k] + hinge]
    rows = [(row, " ".join(some(60) + joined([row % 9]) + some(60))) for row in range(108)]
    rows += [(1000, " ".join(some(60) + joined(range(9)) + some(60))), (1001, " ".join(some(60) + joined([1, 0, 3, 2, 5, 4, 7, 6, 8]) + some(60)))]
    docs = spark.createDataFrame(rows, "__row bigint, text string").repartition(5)
    found = substring_dedup.passages(spark, docs)[0].collect()
    assert {(r.row, r.other) for r in found} == {(1001, 1000)}


def test_texts_with_one_line_in_common_make_no_pairs(spark):
    """A line of 30 words in 200 unlike texts: no window can hold a passage that others have as well, so no pair is made of them; two texts with a similar passage around the line make one."""
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line, before, after = some(30), some(16), some(16)
    rows = [(k, " ".join(some(70) + line + some(70))) for k in range(200)]
    rows += [(1000 + k, " ".join(some(40) + before + [f"x{k}"] + line + [f"y{k}"] + after + some(40))) for k in range(2)]
    docs = spark.createDataFrame(rows, "__row bigint, text string").repartition(5)
    _, _, hits, _ = substring_dedup.candidates(spark, docs)
    none = spark.createDataFrame([], "node bigint, label bigint")
    named = substring_dedup.suspects(spark, docs, hits, none).collect()
    assert {r.row for r in named} <= {1000, 1001}
    assert hits.filter("row < 1000").select("row").distinct().count() > 100


def test_no_window_that_holds_a_passage_is_left_out():
    """holding() against all ranges through a centre, in sequences with few and with many repeats."""
    rng = np.random.default_rng(9)
    kept = 0
    for trial in range(300):
        n = int(rng.integers(46, 150))
        a = rng.integers(0, int(rng.choice([6, 40, 10**6])), n)
        known_values = rng.random(int(a.max()) + 1) < rng.choice([0.7, 0.8, 0.9])
        known = known_values[a]
        before, after, last = np.full(n, -1), np.full(n, n), {}
        for k, x in enumerate(a.tolist()):
            if x in last:
                before[k], after[last[x]] = last[x], k
            last[x] = k
        c = int(rng.integers(0, n))
        want = False
        for p in range(max(0, c - substring_dedup.FAR), c + 1):
            for q in range(max(c, p + substring_dedup.LEAST - 1), min(n, c + substring_dedup.FAR + 1)):
                x = np.unique(a[p : q + 1])
                want |= known_values[x].sum() >= substring_dedup.SIMILARITY * len(x)
        at = lambda x: np.array([x])
        low, high = max(0, c - substring_dedup.FAR), min(n - 1, c + substring_dedup.FAR)
        got = bool(substring_dedup.holding(known.astype(int), 1, before, after, at(low), at(c), at(high))[0])
        assert got or not want
        kept += got
    assert 0 < kept < 300


def test_pairs_that_fit_hold_all_passages():
    """fitting() lets every pair pass that can be confirmed through the middle, in either direction, and few of those near copies that can not."""
    rng = np.random.default_rng(2)
    far, n = substring_dedup.FAR, 2 * substring_dedup.FAR + 1
    whole = rng.integers(1 << 33, 1 << 62, n).astype(np.uint64)
    rows = []
    for _ in range(80):
        x = whole.copy()
        for at in rng.choice(np.delete(np.arange(n // 5), far // 5), int(rng.integers(0, 24)), replace=False):
            x[5 * at : 5 * at + 5] = rng.integers(1 << 33, 1 << 62, 5).astype(np.uint64)
        rows.append(x)
    short = np.stack([(x >> np.uint64(32)).astype(np.uint32) for x in rows])
    i, j = np.nonzero(np.triu(np.ones((80, 80), bool), 1))
    through = lambda x, y: any(p[0] <= far <= p[1] for p in substring_dedup.confirm(x, y))
    want = np.array([through(rows[p], rows[q]) for p, q in zip(i, j)])
    got = substring_dedup.fitting(short, short, i, j, np.ones(len(i), bool)) & substring_dedup.fitting(short, short, j, i, np.ones(len(i), bool))
    assert want.any() and not (want & ~got).any() and got.sum() < 1.5 * want.sum() < len(i)


def test_passages_show_beside_what_is_less_alike():
    """A passage before a stretch with many differences, and one of two repeated words that the other side repeats more often."""
    a = np.arange(200, dtype=np.uint64)
    b = a.copy()
    for at in (30, *range(65, 200, 15)):
        b[at : at + 5] += np.uint64(10**6)
    for found in (substring_dedup.confirm(a, b), substring_dedup.confirm_many([(a, b)])[0]):
        assert found and all(s >= substring_dedup.SIMILARITY and a1 - a0 + 1 >= substring_dedup.LEAST for a0, a1, _, _, s in found)
    few, many = (substring_dedup.sequences([text.encode()]) for text in ("oi " * 25 + "la " * 25, "oi " * 75 + "la " * 45))
    few, many = (hashes[: ends[0]] for hashes, _, ends in (few, many))
    assert [x[4] for x in substring_dedup.confirm(few, many)] == [1.0] and substring_dedup.confirm(many, few)


def test_classes_come_with_the_lines_of_scopes(spark):
    """The innermost class is known from the doubling, so ancestors are opened once, for names."""
    chain = [(f"s{k}", f"s{k - 1}" if k else None, f"C{k}" if k in (0, 3) else None) for k in range(7)] + [("other", None, None), ("leaf", "other", None)]
    scopes = spark.createDataFrame(chain, "scope string, parent string, class string")
    got = {r.scope: (r.line, r["class"]) for r in nesting.lines(spark, scopes).collect()}
    assert got == {f"s{k}": ([f"s{i}" for i in range(k, -1, -1)], "C3" if k >= 3 else "C0") for k in range(7)} | {"other": (["other"], None), "leaf": (["leaf", "other"], None)}
    refs = spark.createDataFrame([(1, "s6", "self.a"), (2, "s2", "cls.b"), (3, "leaf", "self.c")], "ref int, scope string, name string")
    found = nesting.resolved(spark, refs, scopes, spark.createDataFrame([], "scope string, name string, kind string, target string"))
    assert {r.ref: r.qualified for r in found.collect()} == {1: "C3.a", 2: "C0.b", 3: "self.c"}


def test_ids_of_named_ends_are_not_moved_on(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "x", "CALLS"), ("c", "b", "CALLS"), ("y", "a", "READS")], "source string, target string, type string")
    nodes = spark.createDataFrame([("a", "same", ""), ("b", "", "q.b"), ("c", "same", None)], "id string, name string, qualified_name string")
    out = projections.edge_labels(edges, nodes)
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    assert "source#" not in node.children().apply(0).output().mkString(",")
    assert sorted(map(tuple, out.collect())) == [("same", "q.b", "CALLS"), ("same", "x", "CALLS"), ("y", "same", "READS")]
