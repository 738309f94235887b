"""The graph operators: every query against DuckDB on the smallest tables, and golden cases."""

import os
import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import enrich, flow, graph, journal, merge, nesting, projections, snapshots
from loomgraph.plans import registry
from loomgraph.sources import code
from loomgraph.streaming.watch import state as watch_state
from loomgraph.streaming.watch import follow, poll, watch

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows):
    say = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(say(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours = registry.queries()[name](spark, DATA)
    theirs = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert canon(ours.select(*columns).collect()) == canon(theirs.fetchall())


def test_star_impact_cap(spark):
    nodes = spark.createDataFrame([(f"n{i}", "Class", f"N{i}", "Java") for i in range(4)], "id string, type string, name string, language string")
    edges = spark.createDataFrame([("n0", f"n{i}", "CALLS") for i in (1, 2, 3)], "source string, target string, type string")
    assert [r.id for r in graph.impact(spark, nodes, edges, "n0", 5, 2).orderBy("id").collect()] == ["n1", "n2"]
    assert graph.impact(spark, nodes, edges, "absent").count() == 0


def test_impact_equals_queue(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d"), ("b", "e"), ("f", "g")]
    nodes = spark.createDataFrame([(x, "Class", x.upper(), "Java") for x in "abcdefg"], "id string, type string, name string, language string")
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "source string, target string, type string")
    near = lambda n: sorted([(b, "CALLS", "outgoing") for a, b in pairs if a == n] + [(a, "CALLS", "incoming") for a, b in pairs if b == n])
    want, queue = {}, [("a", 0)]
    while queue:
        n, depth = queue.pop(0)
        for m, kind, way in near(n) if depth < 3 else []:
            if m != "a" and m not in want:
                want[m] = (depth + 1, n, kind, way)
                queue.append((m, depth + 1))
    got = {r.id: (r.depth, r.via, r.relation, r.direction) for r in graph.impact(spark, nodes, edges, "a", 3).collect()}
    assert got == want


def test_evidence_is_bounded_in_canonical_order(spark):
    items = spark.createDataFrame([("a", "b", "CALLS", f"{i:02d}") for i in range(35, -1, -1)] * 2, "source string, target string, type string, canon string")
    assert merge.bounded_evidence(items).first().evidence == [f"{i:02d}" for i in range(16)]


def test_placeholder_moves_and_loops_go(spark):
    internal = spark.createDataFrame([("i1", "Java", "a.B", "B", 1), ("i2", "Java", "a.B", "B", 2), ("i3", "Java", "c.D", "D", 3)], "id string, language string, qualified_name string, name string, ordinal int")
    ph = spark.createDataFrame([("p1", "Java", "a.B", "B"), ("p2", "Java", "D", "D"), ("p3", "Java", "x.D", "D")], "id string, language string, qualified_name string, name string")
    r = {x.id: x.to for x in merge.redirects(ph, internal).collect()}
    assert r == {"p1": "i2", "p2": "i3"}
    edges = spark.createDataFrame([("i2", "p1", "CALLS"), ("p2", "p1", "CALLS"), ("p2", "p3", "CALLS")], "source string, target string, type string")
    out = merge.rewrite_edges(edges, merge.redirects(ph, internal)).select("source", "target").collect()
    assert sorted(map(tuple, out)) == [("i3", "i2"), ("i3", "p3")]


@pytest.mark.parametrize(("path", "ok"), [("src/a.py", True), ("/Users/x", False), ("\\Users\\x", False), ("C:\\x", False), ("safe/../x", False), ("", False), ("a\nb", False)])
def test_portable_path(spark, path, ok):
    assert spark.createDataFrame([(path,)], "p string").select(X.portable_path(F.col("p"))).first()[0] is ok


@pytest.mark.parametrize(("name", "role"), [("validate_orders", "Validate"), ("normalizeOrders", "Transform"), ("loaderboard", None), ("candidate", None), ("fetch_and_load", "Extract"), ("restore_backup", None)])
def test_role(spark, name, role):
    assert spark.createDataFrame([(name,)], "n string").select(X.pipeline_role(X.name_tokens(F.col("n")))).first()[0] == role


def test_change_basis(spark):
    rows = [("f", "f", "1", "1", "1", "1", "no_change"), ("f", "g", "1", "1", "1", "1", "source_change"), ("f", "g", "1", "2", "1", "1", "mixed"), ("f", "f", "1", "2", "1", "1", "analyzer_reinterpretation"), ("f", "f", "1", "1", "1", "2", "analysis_refresh"), (None, "f", "1", "1", "1", "1", "legacy_unknown")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, want string")
    assert df.filter(snapshots.change_basis(*[F.col(x) for x in "abcdef"]) != F.col("want")).count() == 0


def test_diff_of_edges(spark):
    s = "id string"
    got = snapshots.diff_keys(spark.createDataFrame([("a",), ("b",)], s), spark.createDataFrame([("a",), ("c",)], s), ["id"])
    assert sorted(map(tuple, got.collect())) == [("b", "removed"), ("c", "added")]


def test_suggestions(spark):
    df = spark.createDataFrame([("n", "Load", 0.9), ("n", "Load", 0.4), ("m", "Load", 0.5), ("m", "Extract", 0.6)], "node string, role string, confidence double")
    assert [tuple(r) for r in enrich.merge_suggestions(df, "node", "role", "confidence").collect()] == [("n", "Load", 0.4, 2)]


@pytest.mark.parametrize(("name", "hidden"), [(".env", True), (".env.staging", True), ("id_rsa", True), ("a.PEM", True), ("token", True), ("api-key.txt", True), ("my_token.json", True), ("secrets.txt", True), ("notes.md", False), ("keys.py", False), (".pem", False), ("monkey.java", False), ("tokenizer.py", False)])
def test_sensitive(spark, name, hidden):
    assert spark.createDataFrame([(name,)], "n string").select(code.sensitive(F.col("n"))).first()[0] is hidden


def test_scan(spark, tmp_path):
    for name, body in (("src/a.py", "x = 1\n"), ("src/B.JAVA", "class B {}"), ("node_modules/c.py", "x"), ("coverage/d.py", "x"), ("Build/e.py", "x"), ("src/out", "x"), ("secrets.txt", "x"), ("d.md", ""), ("src/f.py", "a\udcffb")):
        p = tmp_path / "repo" / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_text(body, errors="surrogateescape")
    for name in ("secrets.txt", "coverage/d.py", "src/api_key.py", "src/big.py"):
        (tmp_path / "repo" / name).write_text("SECRET" if "big" not in name else "x" * (code.MOST_BYTES + 1))
    (tmp_path / "repo" / "src" / "odd[1]{2}.py").write_text("y")
    rows = code.scan(spark, str(tmp_path / "repo"))
    assert rows.filter("skipped is not null and (content is not null or sha256 is not null)").count() == 0
    # only the files that are read are listed for the scan that opens them
    opened = {os.path.basename(f) for f in rows.filter("skipped is null").inputFiles()}
    assert "SECRET" not in str([r.content for r in rows.collect()])
    assert rows.filter("path = 'src/odd[1]{2}.py'").first().content == "y"
    rows = rows.filter("path not in ('src/odd[1]{2}.py', 'src/api_key.py', 'src/big.py')")
    assert opened
    for limits, why in (((2, 1 << 30), "files"), ((99, 8), "bytes")):
        with pytest.raises(code.TooLarge, match=why):
            code.scan(spark, str(tmp_path / "repo"), *limits)
    found = {r.path: (r.language, r.skipped) for r in rows.collect()}
    skipped = ("Python", "excluded_directory")
    assert found == {"src/a.py": ("Python", None), "src/B.JAVA": ("Java", None), "node_modules/c.py": skipped, "coverage/d.py": skipped, "Build/e.py": ("Python", None), "src/f.py": ("Python", None), "secrets.txt": (None, "sensitive_name")}
    assert rows.filter("path = 'src/f.py'").first().content == "a\ufffdb"
    assert {(r.language, r.skipped): r.files for r in code.preflight(rows).collect()} == {("Python", None): 3, ("Java", None): 1, ("Python", "excluded_directory"): 2, (None, "sensitive_name"): 1}


def test_snapshots(spark, tmp_path):
    store, nodes = str(tmp_path / "store"), spark.createDataFrame([("a",)], "id string")
    for k in ("1", "2", "3"):
        snapshots.publish(spark, store, k, nodes, nodes, f"f{k}")
    got = snapshots.history(spark, store, 2).collect()
    assert [(r.snapshot_id, r.previous, r.position, r.truncated, r.nodes) for r in got] == [("3", "2", 1, True, 1), ("2", "1", 2, True, 1)]
    assert [snapshots.alias(spark, store, x) for x in ("current", "previous", "1")] == ["3", "2", "1"]
    nodes.write.parquet(f"{store}/nodes/snapshot_id=4/run=dead")  # a run that died after its nodes
    with pytest.raises(ValueError, match="changed"):
        snapshots.publish(spark, store, "4", nodes, nodes, "f4", lambda: "f5")
    assert snapshots.alias(spark, store, "current") == "3"
    snapshots.publish(spark, store, "4", nodes, nodes, "f4", lambda: "f4")
    assert snapshots.alias(spark, store, "current") == "4"
    again = snapshots.publish(spark, store, "4", nodes, nodes)  # the name is taken, so it gets a suffix
    assert again.startswith("4-") and snapshots.alias(spark, store, "current") == again and snapshots.alias(spark, store, "previous") == "4"
    # of two writers that began from one head, one is promoted
    base = snapshots.head(spark, store)
    done = []

    def writer(k):
        try:
            done.append(snapshots.publish(spark, store, f"w{k}", nodes, nodes, base=base))
        except snapshots.Conflict:
            done.append(None)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 3 and done.count(None) == 2 and snapshots.head(spark, store) == base + 1
    assert snapshots.alias(spark, store, "current") == next(x for x in done if x)
    edges = spark.createDataFrame([("a", "b", "CALLS")], "source string, target string, type string")
    snapshots.publish(spark, store, "5", nodes, edges)
    assert [t.count() for t in snapshots.load(spark, store)] == [1, 1]
    for bad, why in (("4", "lacks"), ("9", "not promoted")):
        with pytest.raises(ValueError, match=why):
            snapshots.load(spark, store, bad)
    registry = spark.createDataFrame([("w1", "b", store, 1), ("w1", "Z", store, 2), ("w2", "a", "/nowhere", 1)], "id string, label string, root string, seq int")
    assert [tuple(r)[:2] + (r.status,) for r in snapshots.workspaces(spark, registry).collect()] == [("w2", "a", "stale"), ("w1", "Z", "available")]


def test_follow_keeps_one_state_per_path(spark, tmp_path):
    """Sightings in several batches, with a restart from the checkpoint between them, equal sightings again, and a path that is no longer seen."""
    source, out = tmp_path / "sightings", str(tmp_path / "changes")
    source.mkdir()
    schema = "path string, sha256 string, seen timestamp"

    def see(name, *rows):
        (source / name).write_text("".join(f'{{"path": "{p}", "sha256": "{d}", "seen": "2024-01-01T{t}:00Z"}}\n' for p, d, t in rows))

    def run():
        stream = follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)), "1 hour")
        stream.writeStream.outputMode("append").format("json").option("checkpointLocation", str(tmp_path / "check")).option("path", out).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.seen.strftime("%H:%M"), r.path, r.change, r.sha256) for r in spark.read.schema(f"{schema}, change string").json(out).collect())

    see("1.json", ("a", "d1", "00:00"), ("b", "d1", "00:00"), ("a", "d2", "00:10"))
    first = [("00:00", "a", "added", "d1"), ("00:00", "b", "added", "d1"), ("00:10", "a", "changed", "d2")]
    assert run() == first
    see("2.json", ("a", "d2", "00:30"))
    assert run() == first
    see("3.json", ("a", "d3", "02:00"), ("c", "d1", "01:20"))
    assert run() == sorted([*first, ("02:00", "a", "changed", "d3"), ("01:20", "c", "added", "d1"), ("01:00", "b", "removed", None)])
    see("4.json", ("b", "d1", "02:10"), ("b", "d0", "00:01"))  # it comes back; what is older than the watermark counts no more
    assert ("02:10", "b", "added", "d1") in run() and len(run()) == 7


def test_watch_sees_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("a")
    seen = []
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "check"), lambda df, k: seen.extend(r.sha256 for r in df.collect())).awaitTermination()
    assert len(seen) == 1


def test_poll_sees_each_content_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    file, other, states, seen = tmp_path / "in" / "a.py", tmp_path / "in" / "b.py", str(tmp_path / "state"), []
    other.write_text("x")
    for body in ("a", "a", "b", "b", None):
        file.write_text(body) if body else file.unlink()
        poll(spark, str(tmp_path / "in"), states, lambda df: seen.append(sorted((r.path[-4:], r.change) for r in df.collect())))
    assert seen == [[("a.py", "added"), ("b.py", "added")], [], [("a.py", "changed")], [], [("a.py", "removed")]]
    with pytest.raises(ZeroDivisionError):
        other.unlink()
        poll(spark, str(tmp_path / "in"), states, lambda df: 1 / 0)
    poll(spark, str(tmp_path / "in"), states, lambda df: seen.append([r.change for r in df.collect()]))
    assert seen[-1] == ["removed"] and watch_state(spark, states).count() == 0
    for k in range(20):  # whole states take the place of looks
        other.write_text(f"x{k}")
        poll(spark, str(tmp_path / "in"), states, lambda df: seen.append([r.change for r in df.collect()]))
    kinds = [n.split("=")[0] for n in os.listdir(states)]
    assert seen[-20:] == [["added"]] + [["changed"]] * 19 and kinds.count("whole") == 1 and kinds.count("look") < 16 and "pending" not in kinds


def test_journal(spark, tmp_path):
    folder = str(tmp_path / "journal")
    for k in range(3):
        journal.record(spark, folder, "decision", f" said {k} ", "declared" if k else "observed", snapshot="s1")
    for bad in (("rumour", "x", "declared"), ("note", " ", "declared"), ("note", "x" * 1001, "declared"), ("note", "x", "heard")):
        with pytest.raises(ValueError):
            journal.record(spark, folder, *bad)
    got = journal.page(journal.read(spark, folder), ["recorded_at"], 1, "declared").collect()
    assert [(r.summary, r.truncated, r.position) for r in got] == [("said 2", True, 1)]
    assert journal.turtle(journal.read(spark, folder), F.lit("t")).count() == 3 * 6
    with pytest.raises(journal.Conflict):
        journal.record(spark, folder, "note", "late", "declared", after=2)
    other, lines = str(tmp_path / "other"), str(tmp_path / "lines")
    threads = [threading.Thread(target=journal.record, args=(spark, other, "note", f"n{k}", "declared")) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.summary for r in journal.read(spark, other).collect()) == ["n0", "n1", "n2", "n3"] and journal.head(spark, other) == 4
    journal.record(spark, other, "note", "n4", "declared", rendered=lines)
    assert spark.read.text(lines).count() == 5 * 5
    (tmp_path / "journal" / "part-x.json").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        journal.read(spark, folder).collect()


@pytest.mark.parametrize(("text", "bad"), [("plain text", False), ("see http://host/path and https://x", False), ("see /etc/passwd", True), ("//host/x", True), ("a/b and c/d", False), ("C:\\x", True), ("D:/x y", True), ("abcC:\\x", True), ("abcC:/x", True), ("abc.x/y", False), ("\\\\host\\share", True), ("a \\dir", True), ("file:///x", True), ("FILE://x", True), ("profile:x", False), ("ftp:/x", True), ("1/2", False), ("tab\there", True), ("z\u200dz", True), (". / .", False)])
def test_unsafe_text(spark, text, bad):
    assert spark.createDataFrame([(text,)], "x string").select(X.unsafe_text(F.col("x"))).first()[0] is bad


NODE = "id string, type string, name string, language string, qualified_name string"


def test_ambiguous_symbol(spark):
    nodes = spark.createDataFrame([("a", "Class", "Shared", "Java", "x.Shared"), ("b", "Class", "Shared", "Java", "y.Shared"), ("c", "Class", "SharedMore", "Java", "y.SharedMore")], NODE)
    edges = spark.createDataFrame([("c", "a", "CALLS")], "source string, target string, type string")
    status = lambda s: graph.impact_of(spark, nodes, edges, s, graph.full_text(nodes))
    assert status("shared")[0] == "ambiguous" and sorted(r.id for r in status("shared")[1].collect()) == ["a", "b"]
    assert status("nothing")[0] == "not_found" and status("nothing")[1].count() == 0
    assert status("SharedMore")[0] == "ok" and [r.id for r in status("y.sharedmore")[1].collect()] == ["a"]
    many = spark.createDataFrame([(f"n{i:02d}", "Class", "Same", "Java", None) for i in range(30)], NODE)
    assert [r.position for r in graph.resolve(many, ["same"], graph.full_text(many)).orderBy("position").collect()] == list(range(1, 21))


def test_candidates(spark):
    rows = [(f"n{i:03d}", "Function", f"f{i}", "Python", f"m.f{i}") for i in range(99, -1, -1)] + [("a" * 1001, "Function", "x", "Python", "m.x"), ("b\u202e", "Function", "x", "Python", "m.x"), ("c", "Package", "x", "Python", "m")]
    nodes = spark.createDataFrame(rows, NODE)
    edges = spark.createDataFrame([("n001", f"n{i:03d}", "CALLS") for i in range(99, 1, -1)] + [("n000", "role", "HAS_PIPELINE_ROLE"), ("n001", "n002", "DECLARES")], "source string, target string, type string")
    found = enrich.candidates(nodes, edges)
    assert sorted(r.id for r in found.collect()) == [f"n{i:03d}" for i in range(1, 81)]
    got = enrich.candidate_relations(found, nodes, edges).orderBy("k").collect()
    assert [r.target_qualified_name for r in got] == sorted(f"m.f{i}" for i in range(2, 100))[:12]
    asked = spark.createDataFrame([("n001", "Load"), ("zz", "Load")], "node string, role string")
    assert [r.node for r in enrich.unknown_suggestions(asked, found, "node").collect()] == ["zz"]


def test_suggestion_counters(spark):
    said = [("n", r) for r in ["Load", "Load", "Odd", "Extract", "Load"]] + [("m", r) for r in ["Load", "Load", "Load"]]
    df = spark.createDataFrame([(*x, k) for k, x in enumerate(said)], "node string, role string, k int")
    assert tuple(enrich.suggestion_counters(df, "node", "role", "k").first()) == (1, 3, 3)


def test_required_limitation(spark):
    none = spark.createDataFrame([(["z.limit", "a.limit", "z.limit", "No"], "runtime_unknown"), (["z.limit"], "not_applicable"), ([f"a{i:02d}" for i in range(40)], "runtime_unknown"), (None, "runtime_unknown")], "l array<string>, s string")
    got = [r[0] for r in none.select(projections.with_required_limitation(F.col("l"), F.col("s"))).collect()]
    want = "runtime.activation_not_observed"
    assert got == [["a.limit", want, "z.limit"], ["z.limit"], [f"a{i:02d}" for i in range(15)] + [want], [want]]


def test_owner_cycles(spark):
    edges = spark.createDataFrame([(a, b, "DECLARES") for a, b in ["ab", "bc", "ca", "cd", "de", "ef", "fg", "gh", "hi", "ij", "jk"]], "source string, target string, type string")
    nodes = spark.createDataFrame([(x, "Class", x, "Java") for x in "abcdefghijkz"], "id string, type string, name string, language string")
    owner = dict((b, a) for a, b in ["ab", "bc", "ca", "cd", "de", "ef", "fg", "gh", "hi", "ij", "jk"])
    for r in graph.owner_trail(nodes, edges).collect():
        want, at = [], r.id
        while len(want) < 6 and (at := owner.get(at)) and at != r.id and at not in want:
            want.append(at)
        assert r.trail == want, r.id


@pytest.mark.parametrize(("name", "ok"), [("library/model:7b", True), ("a/../b", False), ("a//b", False), ("", False), ("-x", False), ("a:b:c", False)])
def test_model_name(spark, name, ok):
    assert spark.createDataFrame([(name,)], "x string").select(X.model_name(F.col("x"))).first()[0] is ok


def test_small_scalars(spark):
    row = spark.createDataFrame([("sha256:" + "a" * 64, "b" * 63, "a.b.c", "abc", float("nan"), 7.126, -1.0)], "d string, e string, s string, t string, n double, v double, w double")
    got = row.select(X.model_digest(F.col("d")), X.model_digest(F.col("e")), X.last_segment(F.col("s")), X.last_segment(F.col("t")), *[X.bounded_number(F.col(c), 5.0) for c in "nvw"], X.bounded_text(F.lit("  x y "), 2), X.bounded_text(F.lit(" \n "), 9)).first()
    assert tuple(got) == ("sha256:" + "a" * 64, None, "c", "abc", 0.0, 5.0, 0.0, "x ", None)


def test_empty_tables(spark):
    n = spark.createDataFrame([], "id string, type string, name string, language string")
    e = spark.createDataFrame([], "source string, target string, type string")
    assert graph.impact(spark, n, e, "x").count() == graph.degrees(e).count() == graph.default_seed(n, e, "explore").count() == 0


@pytest.mark.parametrize("bits", [3, 16])
def test_every_row_is_batched(spark, bits):
    sizes = {"a": [1 + i * 37 % 3000 for i in range(25_000)], "b": [20_000, 1, 16_384, 1], None: [0] * 45}
    rows = [(g, k, x) for g, some in sizes.items() for k, x in enumerate(some)]
    want = set()
    for g, some in sizes.items():
        batches = [[]]
        for k, x in enumerate(some):
            if len(batches[-1]) == 20 or (batches[-1] and sum(batches[-1]) + x > 16_384):
                batches.append([])
            batches[-1].append(x)
            want.add((g, k, len(batches) - 1))
    got = enrich.greedy_batches(spark.createDataFrame(rows[::-1], "g string, k bigint, n int").repartition(5), "g", "k", "n", bits).collect()
    assert len(got) == len(rows) and {(r.g, r.k, r.batch) for r in got} == want


def test_no_task_holds_a_hot_source(spark):
    """A source with nearly all rows: its segments are summed up in many tasks."""
    from loomgraph.operators import folds

    rows = spark.range(20_000).select(F.when(F.col("id") < 10, "b").otherwise("a").alias("g"), "id")
    cut = folds.ranged(spark, rows, ["g"], ["id"], "hot", 10)
    sizes = [r.n for r in cut.groupBy("__segment").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 1024 and sum(sizes) == 20_000
    told = folds.running_total(spark, rows, ["id"], F.col("id"), 8).orderBy("id").collect()
    assert [r.position for r in told] == list(range(1, 20_001)) and told[-1].total == sum(range(20_000))


@pytest.mark.parametrize("bits", [2, 16])
def test_guards_equal_a_queue(spark, bits):
    rng = random.Random(1)
    rows = []
    for key in ("m", "n", None):
        for at in range(150):
            kind = rng.choice(["read", "assign", "assign", "condition"])
            uses = rng.choices(["x", "y", "z", "w"], k=rng.randint(0, 2)) or None
            rows.append((key, at, kind, at, rng.choice(["x", "y", "z", None if kind == "read" else "x"]), uses))
    want = set()
    for key in ("m", "n", None):
        mine = [r for r in rows if r[0] == key]
        for _, at, kind, ident, variable, _ in mine:  # each read alone, as it is defined
            tainted = {variable} if kind == "read" and variable else set()
            for _, later, what, other, v, uses in mine:
                if kind == "read" and later > at:
                    held = bool(tainted & set(uses or ()))
                    if what == "condition" and held:
                        want.add((key, ident, other))
                    if what == "assign":
                        tainted = tainted | {v} if held else tainted - {v}
                    if what == "read":
                        tainted = tainted - {v}
    df = spark.createDataFrame(rows[::-1], "method string, at int, kind string, ident int, variable string, uses array<string>")
    got = flow.guarded(spark, df, "method", ["at"], bits).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_overwritten_and_unused_reads_guard_nothing(spark):
    """The policy reads of one method: only the one whose value reaches a condition guards it."""
    rows = [(1, "read", "timeout", "t", None), (2, "assign", None, "out", ["t"]), (3, "condition", "c1", None, ["out"]), (4, "read", "unused", "u", None), (5, "read", "over", "o", None), (6, "assign", None, "o", []), (7, "condition", "c2", None, ["o"])]
    df = spark.createDataFrame([("m", *r) for r in rows], "method string, at int, kind string, ident string, variable string, uses array<string>")
    assert [tuple(r) for r in flow.guarded(spark, df, "method", ["at"]).collect()] == [("m", "timeout", "c1")]


@pytest.mark.parametrize("bits", [1, 16])
def test_nesting_equals_brute_force(spark, bits):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), k, b := rng.randrange(60), b + rng.choice([0, 1, 3, 9, 30])) for k in range(250)] + [("a", 900, None, 3)]
    got = nesting.nested(spark, spark.createDataFrame(rows, "k string, id int, b int, e int"), "k", "id", F.col("b"), F.col("e"), bits).collect()
    parent = {}
    for k, i, b, e in rows[:-1]:
        around = [(b2, -e2, i2) for k2, i2, b2, e2 in rows[:-1] if k2 == k and (b2, -e2, i2) < (b, -e, i) and e2 >= e]
        parent[i] = max(around)[2] if around else None
    depth = lambda i: 0 if parent[i] is None else 1 + depth(parent[i])
    assert {(r.id, r.parent, r.depth) for r in got} == {(i, p, depth(i)) for i, p in parent.items()} and len(got) == 250


def test_brackets(spark):
    for text, want in {"f(a,(b,c),d)": [(1, 11, 0, 2, 3), (4, 8, 1, 1, 2)], "()": [(0, 1, 0, 0, 0)], "(a": [(0, None, 0, 0, None)], ")(a)": [(1, 3, -1, 0, 1)], "(())": [(0, 3, 0, 0, 1), (1, 2, 1, 0, 0)], "((a,b)": [(0, None, 0, 0, None), (1, 5, 1, 1, 2)]}.items():
        kinds = {"(": "open", ")": "close", ",": "separator"}
        df = spark.createDataFrame([("k", i, kinds.get(c, "x")) for i, c in enumerate(text)], "k string, i int, kind string")
        got = sorted(tuple(r)[1:] for r in nesting.matched(df, ["k"], "i").collect())
        assert [(a, b, d, s if b is not None else 0, n) for a, b, d, s, n in got] == want, text


@pytest.mark.parametrize(("source", "want"), [
    ("a // b\nc", "a     \nc"), ("x = \"a//b\"; // y", "x =       ;     "), ("/* a\n b */c", "    \n     c"), ("'\\'' + d", "     + d"), ('"a\\\\" + e', "      + e"), ('"""x\n"y" """z', "    \n       z"), ("/*/ a */b", "        b"), ("a / b", "a / b"), ('"open', "     "), ("/* open", "       "), ("", ""), ("//", "  "), ('"a\\\nb"', "   \n  "),
])
def test_masks_keep_places(spark, source, want):
    assert spark.createDataFrame([(source,)], "x string").select(X.masked(F.col("x"))).first()[0] == want


SCOPE, BIND = "scope string, parent string, class string", "scope string, name string, kind string, target string"


def test_names_resolve_by_scope(spark):
    """Nested functions, closures, a global that lets the module's import through, locals that hide it, class methods and bare module names."""
    scopes = [("m", None, None), ("outer", "m", None), ("inner", "outer", None), ("go", "m", None), ("gi", "go", None), ("C", "m", "m.C"), ("C.a", "C", None), ("C.a.f", "C.a", None), ("shadow", "m", None), ("loc", "m", None)]
    binds = [("m", "caught", "import", "pkg"), ("m", "b", "symbol", "m.b"), ("m", "C", "symbol", "m.C"), ("outer", "helper", "symbol", "m.outer.helper"), ("outer", "helper", "local", None), ("go", "caught", "local", None), ("gi", "caught", "global", None), ("shadow", "caught", "local", None), ("loc", "mod", "import", "pkg.mod"), ("m", "b", "import", "other.b")]
    refs = [("inner", "helper", "m.outer.helper", "symbol"), ("gi", "caught.run", "pkg.run", "module_import"), ("shadow", "caught.run", "caught.run", "local"), ("loc", "mod.run", "pkg.mod.run", "import"), ("C.a", "self.b", "m.C.b", "self"), ("C.a.f", "cls.x.y", "m.C.x.y", "self"), ("C.a", "self", "self", "unresolved"), ("C.a", "b", "other.b", "module_import"), ("C.a", "C", "m.C", "module_symbol"), ("C.a", "C.z", "C.z", "unresolved"), ("m", "caught", "pkg", "module_import"), ("go", "nothing.x", "nothing.x", "unresolved"), ("outer", "self.b", "self.b", "unresolved")]
    got = nesting.resolved(spark, spark.createDataFrame([(k, s, n) for k, (s, n, *_) in enumerate(refs)], "ref int, scope string, name string"), spark.createDataFrame(scopes, SCOPE), spark.createDataFrame(binds, BIND))
    assert {r.ref: (r.qualified, r.how) for r in got.collect()} == {k: (q, h) for k, (_, _, q, h) in enumerate(refs)}


def test_levels_read_their_buckets_only(spark, tmp_path):
    """Stored adjacency: the same hops as from plain edges; each level prunes buckets."""
    rng = random.Random(3)
    edges = spark.createDataFrame([(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}", rng.choice(["CALLS", "DECLARES"])) for _ in range(500)], "source string, target string, type string")
    nodes = spark.createDataFrame([(f"n{i}", "Class", f"N{i}", "Java") for i in range(300)], "id string, type string, name string, language string")
    stored = graph.Adjacency(spark, str(tmp_path / "adjacency"), edges, 16)
    wanted = stored.near(["n1", "n2"], ("outgoing", "incoming"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells its buckets
    plan = stored.near(["n1", "n2"], ("outgoing", "incoming"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 2 out of 16" in plan or "SelectedBucketsCount: 1 out of 16" in plan
    for ways in (("outgoing", "incoming"), ("outgoing",)):
        plain = sorted(map(tuple, graph.impact(spark, nodes, edges, "n1", 3, directions=ways).collect()))
        assert sorted(map(tuple, graph.impact(spark, nodes, stored, "n1", 3, directions=ways).collect())) == plain
    spark.sql(f"DROP TABLE {stored.table}")  # another session knows the folder only
    again = graph.Adjacency(spark, str(tmp_path / "adjacency"))
    assert again.buckets == 16 and again.near(["n1"], ("outgoing", "incoming")).count() == edges.filter("source = 'n1'").count() + edges.filter("target = 'n1'").count()
    # a level opens no other bucket's files: without them, it finds the same
    few = again.near(["n1"], ("outgoing", "incoming"))
    rows, needed = few.count(), {os.path.basename(r[0]) for r in few.select(F.input_file_name()).distinct().collect()}
    for f in (tmp_path / "adjacency" / "rows").iterdir():
        if f.name.startswith("part-") and f.name not in needed:
            f.write_bytes(b"broken")
    assert again.near(["n1"], ("outgoing", "incoming")).count() == rows and wanted.columns == few.columns
    again.drop()
    assert not os.path.exists(tmp_path / "adjacency")


def test_plans_read_their_tables_once(spark):
    """What is used several times is written once, so the last plans hold few scans."""
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    queries = registry.queries()
    for name in ("lens_neighbourhood", "owner_trail", "diff_full"):
        assert scans(queries[name](spark, DATA)) < 15, name


CAPPED = ["impact_truncated", "impact_neighbourhood", "lens_neighbourhood", "search_substring", "search_ranked", "lineage_filtered", "repository_limits", "grouped_relations", "relations_topk_per_candidate"]


@pytest.mark.parametrize("name", CAPPED)
def test_capped_query_equals_sql_on_more_rows(spark, name):
    """Bounds that the smallest tables don't reach."""
    more = DATA.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{more}/{t}.parquet'")
    ours, theirs = registry.queries()[name](spark, more), con.execute(registry.oracle_sql()[name])
    assert canon(ours.select(*[c[0] for c in theirs.description]).collect()) == canon(theirs.fetchall())


@pytest.mark.parametrize("bits", [2, 16])
def test_innermost_equals_brute_force(spark, bits):
    rng = random.Random(4)
    scopes = [(rng.choice(["a", "a", None]), k, b := rng.randrange(80), b + rng.choice([0, 1, 2, 5, 20, 60])) for k in range(200)]
    places = [(rng.choice(["a", "a", None]), k, rng.randrange(90)) for k in range(300)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = nesting.innermost(spark, df(places, "k string, p int, at int"), df(scopes, "k string, s int, b int, e int"), "k", "p", F.col("at"), "s", F.col("b"), F.col("e"), bits).collect()
    want = {}
    for k, p, at in places:
        around = [(b, s) for k2, s, b, e in scopes if k2 == k and b < at < e]
        if around:
            want[p] = max(around)[1]
    assert {r.p: r.scope for r in got} == want and len(got) == len(want)


def test_rules_fill_what_evidence_leaves_out(spark):
    rows = [("CALLS", None, None, None), ("INJECTS", "", "resolved_static", None), ("ODD_KIND", None, "", "runtime_unknown"), ("DECLARES", "own.rule", None, None)]
    got = projections.with_rules(spark.createDataFrame(rows, "type string, rule_id string, basis string, runtime_status string")).collect()
    assert sorted(map(tuple, got)) == [
        ("CALLS", "core.calls", "resolved_static", "not_applicable"), ("DECLARES", "own.rule", "direct_syntax", "not_applicable"), ("INJECTS", "java.spring.injection", "resolved_static", "runtime_unknown"), ("ODD_KIND", "core.odd_kind", "direct_syntax", "runtime_unknown"),
    ]


def test_quality_reports_of_both_spellings(spark):
    rows = [(1, None, "1.0", 10, None, (7, 20, -4, 250.0)), (2, "legacy_unknown", None, None, None, (7, 3, 9, float("nan"))), (3, "odd", None, None, 5, None), (4, "documented", None, 2_000_000, 3, None)]
    schema = "scope int, status string, contract_version string, totalEdges bigint, documentedEdges bigint, relationship_evidence struct<total_edges:bigint,documented_edges:bigint,missing_evidence:bigint,coverage_percent:double>"
    got = projections.api_quality(spark.createDataFrame(rows, schema)).orderBy("scope").collect()
    assert [tuple(r)[1:] for r in got] == [("documented", "1.0", 10, 10, 0, 100.0), ("legacy_unknown", "legacy_unknown", 7, 3, 7, 0.0), ("legacy_unknown", "legacy_unknown", 0, 0, 0, 0.0), ("documented", "unknown", 1_000_000, 3, 0, 0.0)]


def test_too_many_symbols(spark):
    nodes = spark.createDataFrame([("a", "Class", "A", "Java", "x.A")], NODE)
    with pytest.raises(ValueError, match="at most"):
        graph.resolve(nodes, [str(k) for k in range(101)], graph.full_text(nodes))
