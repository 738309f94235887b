"""The training-data operators against brute force, on small tables with nulls, ties, copies, empty and long texts, and clashing names."""

import collections
import hashlib
import math
import os
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
import xxhash

from loomgraph.llm import bpe, brown, common, exact_dedup, mixing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, toxicity
from loomgraph.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty red orange yellow green blue indigo violet white black grey brown pink"
ROWS = [
    (1, "Hello  world", "en", "a", "x"), (2, "Hello world", "en", "a", "x"), (2, "Hello world", "en", "a", "x"), (None, "Hello\nworld", None, None, None), (3, None, "en", None, "x"),
    (4, "", "en", "b", "x"), (5, " \t\n", None, "b", "x"), (6, LONG, "en", "c", "x"), (7, LONG + " end", "en", "c", "x"), (8, "Straße ΣΑΣ 日本語 <|endoftext|> it's", "de", "b", None),
    (9, PROSE, "en", "a", "x"), (10, "intro words here " + PROSE + " and more", "en", "b", "x"), (11, "aaa " * 200, "en", "b", "x"), (12, "mail me@x.org or 123456\nsame line\nsame line\n", "en", "c", "x"),
]
#: Extra columns with names that operators use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, `kept` string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def raw(text):
    return (text or "").encode()


def test_exact_dedup(spark, docs, empty):
    got = exact_dedup.exact_dedup(spark, docs).collect()
    groups = collections.defaultdict(list)
    for d, t, *_ in ROWS:
        groups[hashlib.sha256(re.sub(rb"[\x20\x09-\x0D]", b"", raw(t))).hexdigest()].append((-len(t or ""), d is None, d or 0))
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len(groups)
    for r in got:
        want = min(groups[r.text_sha256])
        assert (r.group_size, r.keep_id) == (len(groups[r.text_sha256]), None if want[1] else want[2])
    kept = exact_dedup.keep_first_copies(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(spark, empty).count() == exact_dedup.keep_first_copies(spark, empty).count() == 0


def test_index_persists(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    first = exact_dedup.exact_dedup(spark, docs.filter("doc_id < 5"), index, "one").collect()
    known = {r.text_sha256 for r in first}
    for k in range(2):  # a batch that is repeated adds nothing and decides alike
        second = exact_dedup.exact_dedup(spark, docs, index, "two", retry=k > 0).collect()
        assert all(r.known == (r.text_sha256 in known) and not (r.known and r.kept) for r in second)
        assert index.rows().count() == len({r.text_sha256 for r in second})
        assert sum(r.kept for r in second) == len({r.text_sha256 for r in second} - known)
    # other rows under a name that is taken are no retry, and a batch without a name goes into no index
    for name in ("two", None):
        with pytest.raises(ValueError, match="batch"):
            exact_dedup.keep_first_copies(spark, docs, index, name)
    assert exact_dedup.keep_first_copies(spark, docs, index, "three").count() == 0
    index.drop()


def test_batches_decide_as_one(spark, docs, empty):
    """Copies in several batches, the better one before or behind: as all rows at once."""
    whole = sorted(map(str, exact_dedup.exact_dedup(spark, docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    for n in (1, 2, 5):
        got = exact_dedup.dedup_in_batches(spark, docs, n).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(str, got)) == whole
    assert exact_dedup.dedup_in_batches(spark, empty).count() == 0


SESSION = """
import sys
from pyspark.sql import SparkSession
from loomgraph.llm import exact_dedup
own, batch = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", sys.argv[2]).config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", own + "/warehouse").config("spark.checkpoint.dir", "file://" + own + "/shared").getOrCreate()
index = exact_dedup.DigestIndex(spark, own + "/index")
docs = spark.createDataFrame([(i, f"text {i}") for i in range(int(batch) + 3)], "doc_id bigint, text string")
out = exact_dedup.exact_dedup(spark, docs, index, batch).collect()
print("KEPT", index.buckets, index.rows().count(), sorted(r.doc_id for r in out if r.kept), sorted(r.doc_id for r in out if r.known))
"""


def test_another_session_opens_the_index(tmp_path):
    """Two applications, one after the other, with the same folder and the default catalog, that is in memory."""
    said = []
    for batch in ("2", "4"):
        run = subprocess.run([sys.executable, "-c", SESSION, str(tmp_path), batch], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": ":".join(sys.path)})
        said += [x for x in run.stdout.splitlines() if x.startswith("KEPT")] or [run.stderr]
    assert said == ["KEPT 2 5 [0, 1, 2, 3, 4] []", "KEPT 2 7 [5, 6] [0, 1, 2, 3, 4]"]


def fingerprint(text):
    w = text.lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(points):
    label = list(range(len(points)))
    for _ in points:
        for i, a in enumerate(points):
            for j, b in enumerate(points):
                if (a ^ b).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash_equals_brute_force(spark, docs, empty, small):
    got = simhash.near_duplicates(spark, docs).collect()
    fp = [fingerprint(raw(t)) for _, t, *_ in ROWS]
    assert sorted(r.fp % (1 << 64) for r in got) == sorted(fp)
    label = components(fp)
    least = {k: min((ROWS[i][0] for i in range(len(fp)) if label[i] == k and ROWS[i][0] is not None), default=None) for k in label}
    by = {f: least[k] for f, k in zip(fp, label)}
    assert all(r.component_id == by[r.fp % (1 << 64)] for r in got)
    assert simhash.keep_leaders(spark, docs).count() == len(set(label))
    assert simhash.near_duplicates(spark, empty).count() == 0
    assert all(fingerprint(x.text.encode()) == simhash.fingerprint(x.text.encode()) for x in small[0].collect())


def test_pigeonring_loses_no_link(spark):
    rng = np.random.default_rng(1)
    points = {int(x) for x in rng.integers(0, 1 << 63, 40)}
    for p in [*points]:
        for _ in range(6):
            a, b = rng.integers(0, 64, 2)
            points.add(p := p ^ (1 << int(a)) ^ (1 << int(b)))
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    got = {r.node: r.label for r in simhash.components(spark, edges).collect()}
    label = components(points)
    ours = collections.defaultdict(set)
    for s, k in zip(signed, label):
        ours[k].add(got.get(s, s))
    assert all(len(x) == 1 for x in ours.values()) and len({min(x) for x in ours.values()}) == len(ours)


def test_bpe_equals_library(spark, docs, empty, small):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    lib.no_padding()
    lib.no_truncation()
    for table in (docs, small[0]):
        for r in bpe.encode_documents(table, vocabulary()).collect():
            want = lib.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False)
    r = {x.doc_id: x for x in bpe.digest_documents(docs, vocabulary()).collect()}
    assert r[3].n_tokens == 0 and r[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(empty, vocabulary()).count() == bpe.digest_documents(empty, vocabulary()).count() == 0
    again = bpe.encode_documents(docs.selectExpr("*", "1 AS ids", "2 AS decoded"), vocabulary())
    assert again.columns == [*docs.columns, "ids", "decoded"] and again.count() == len(ROWS)


def test_long_word_equals_short_path():
    coder = bpe.Bpe(vocabulary())
    for word in ("abcabcx" * 9, "thethethe" * 7, "!" * 60):
        assert coder.merge_together([word.encode()])[0] == coder.merge_alone(word.encode())


def edited(text, edits):
    want, at = b"", 0
    for a, b, x in edits:
        want, at = want + text[at:a] + x, b
    return want + text[at:]


def test_token_counts_equal_recount(spark, docs, empty):
    coder = bpe.Bpe(vocabulary())
    leaf = token_counts.LeafCoder(coder)
    count = lambda t: len(coder.encode([t])[0]) // 4
    rng = np.random.default_rng(3)
    some = [raw(t) for _, t, *_ in ROWS if t != LONG] + [b"a b  c", "e\u0300 x".encode(), b"it's'll!'re''s1'2've<|endoftext|>a<|startoftext|>'t"]
    some += ["".join(rng.choice([*"ab'!1<|>é\u0301e\u0308n\u0303\u1100\u1161\u11a8İßΣ中，\u00a0\x1c", "'re", "<|endoftext|>", "end", " "], 120)).encode() for _ in range(60)]
    new_parts = [b"", b" ", b"new Words", b"x", b"'", b"re", b"s", b"<|", b"|>", "\u0301".encode(), "\u11a8".encode(), b"7", b"<|endoftext|>", "中".encode()]
    for text in some:
        kept = token_counts.keep(leaf.leaves([text])[0])
        for _ in range(12):  # trees that are kept, edited, kept and edited again
            bounds = [i for i in range(len(text) + 1) if i == len(text) or text[i] & 0xC0 != 0x80]
            cuts = sorted(int(x) for x in rng.choice(bounds, 2 * min(3, (len(bounds) + 1) // 2)))
            edits = [(a, b, new_parts[int(rng.integers(len(new_parts)))]) for a, b in zip(cuts[::2], cuts[1::2])]
            new, leaves, total, _ = token_counts.apply_edits(leaf, text, token_counts.kept(kept), edits)
            assert new == edited(text, edits) and total == count(new), (text, edits)
            assert (leaves[2] >= 0).all() and leaves[2].sum() == total and (leaves == token_counts.kept(token_counts.keep(leaves))).all()
            if new.isascii():
                assert (leaves == leaf.leaves([new])[0]).all(), (text, edits)
            text, kept = new, token_counts.keep(leaves)
    got = token_counts.count_edited(spark, docs, vocabulary()).collect()
    assert len(got) == len(ROWS) and token_counts.count_edited(spark, empty, vocabulary()).count() == 0
    twelve = next(r for r in got if r.doc_id == 12)
    assert twelve.n_edits == 3 and twelve.n_tokens_edited == count(b"mail <masked> or <masked>\nsame line\n")


def test_edits_of_text_without_spaces_stay_local():
    leaf = token_counts.LeafCoder(bpe.Bpe(vocabulary()))
    for text in (b"ab1,cd-" * 5000, "中文，字。".encode() * 3000, b"x'll." * 6000):
        leaves = leaf.leaves([text])[0]
        new, after, total, again = token_counts.apply_edits(leaf, text, leaves, [(len(text) // 30 * 15, len(text) // 30 * 15, b"q")])
        assert again < 80 and len(new) == len(text) + 1 and total == int(leaf.leaves([new])[0][2].sum()) == int(after[2].sum())


def test_trees_are_kept_between_batches_of_edits(spark):
    coder = bpe.Bpe(vocabulary())
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "a,b,c")], "doc_id bigint, text string")
    trees = common.stage(spark, token_counts.build_trees(docs, vocabulary()), "trees")
    marks = "array<struct<start:int,end:int,replacement:string>>"
    for k in range(3):
        trees = common.stage(spark, token_counts.edit_trees(trees.selectExpr("*", f"cast(array(struct(0, 0, 'w{k} ')) as {marks}) AS edits"), vocabulary(), "edits"), "trees")
    got = {r.doc_id: (r.text, r.n_tokens) for r in trees.collect()}
    assert {k: x[0] for k, x in got.items()} == {1: "w2 w1 w0 alpha beta gamma", 2: "w2 w1 w0 ", 3: "w2 w1 w0 a,b,c"}
    assert all(n == len(coder.encode([t.encode()])[0]) // 4 for t, n in got.values())


def test_addresses_behind_each_other_are_masked():
    plain = re.compile(rb"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+|[0-9]{4,}")
    rng = np.random.default_rng(6)
    some = [b"a@b.org+c@d.org", b"a@b.org_c@d.org x", b"a@b+c@d+e@f", b"a@b+12345", b"12345@x+1@2", b"@", b"a@@b@c_1234_d@e"]
    some += [bytes(rng.choice([*b"a1234.+_@ -\n#"], 40).astype(np.uint8)) for _ in range(3000)]
    for text in some:
        for line in text.split(b"\n"):
            assert [*token_counts.masked(line)] == [m.span() for m in plain.finditer(line)], line
    assert [token_counts.MASK] * 2 == [e[2] for e in token_counts.cleaning_edits(b"a@b.org+c@d.org")]
    assert len([*token_counts.masked(b"1234a" * 40_000 + b" @")]) == 40_000  # in linear time


def test_mixing(spark, docs, empty):
    got = mixing.mix(spark, docs).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(WORD.findall(raw(t)))
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:  # share, cap, share again
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)
        left = sum(sizes.values()) - sum(target.values())
    assert len(got) == len(ROWS)
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
    assert sorted(map(tuple, mixing.mix(spark, docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.repeat_to_mix(spark, docs).columns == docs.columns
    assert mixing.mix(spark, empty).count() == mixing.repeat_to_mix(spark, empty).count() == 0


def test_quality_rules(spark, docs, empty):
    got = quality_rules.quality_rules(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, t, *_ in ROWS:
        w = [x.decode() for x in WORD.findall(raw(t))]
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x.encode())]
        r = by[d][0]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert by[9][0].kept and quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.verdict(b"ab" * 4000, __import__("zstandard").ZstdCompressor(level=3))[3] == "repetitive"
    assert quality_rules.verdict(np.random.default_rng(0).bytes(9000), __import__("zstandard").ZstdCompressor(level=3))[3].startswith("incompressible")


def test_all_chunks_count_together():
    import zstandard

    zstd, rng = zstandard.ZstdCompressor(level=3), np.random.default_rng(4)
    prose = lambda n: b" ".join(b"%c%d" % (97 + int(x) % 26, x) for x in rng.integers(0, 3000, n))[:n]
    junk, line = rng.bytes(4096), (b"the same line over again\n" * 200)[:4096]
    good = prose(4096 * 20)
    assert quality_rules.verdict(good, zstd)[3] == ""
    mixed = good[: 4096 * 10] + b"".join([junk, line]) * 5
    low, high = quality_rules.band(len(mixed))
    ratio, _, _, why = quality_rules.verdict(mixed, zstd)
    assert ratio > 0 and why != ""
    few = good[: 4096 * 14] + (rng.bytes(4096) + line) * 3
    ratio, _, _, why = quality_rules.verdict(few, zstd)
    assert low <= ratio <= high and why == "mixed chunks"
    tail = good[:4096] + rng.bytes(2000)  # in no whole chunk
    assert quality_rules.verdict(tail, zstd)[1] < quality_rules.CHUNK_BAND[0]


def test_quality_classifier(spark, docs, empty, small):
    texts = ["good plain words here " * 3 + f"t{i}" for i in range(60)] + ["SO BAD!! VERY!! BAD!! " * 3 + f"T{i}!!" for i in range(60)] + ["middling | text | here | " * 3 + f"m{i}" for i in range(60)]
    model = quality_classifier.fit([x.encode() for x in texts], [2] * 60 + [0] * 60 + [1] * 60)
    z = quality_classifier.scorer(model)([b"good plain words here " * 2, b"middling | text | here | " * 2, b"SO BAD!! VERY!! BAD!! " * 2])
    assert list(np.round(model.expected(z))) == [2, 1, 0] and (np.diff(model.thresholds) > 0).all()
    assert quality_classifier.classify(docs, model).count() == len(ROWS) and quality_classifier.classify(empty, model).count() == 0
    assert quality_classifier.keep_selected(docs, model).columns == docs.columns
    none = quality_classifier.train(spark, docs, small[1].limit(0))
    assert quality_classifier.keep_selected(docs, none).count() == len(ROWS)


def test_classifiers_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    want = {r.doc_id: r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    net = toxicity.train(spark, docs, labels)
    hit = [(want[r.doc_id].toxic, r.predicted, r.score) for r in toxicity.score_documents(docs, net).collect() if r.doc_id in want]
    tp = sum(a and b for a, b, _ in hit)
    assert tp / sum(a for a, _, _ in hit) > 0.85 and tp / sum(b for _, b, _ in hit) > 0.95 and all(0 <= s <= 1 for *_, s in hit)
    model = quality_classifier.train(spark, docs, labels)
    right = [(want[r.doc_id].quality == 1) == r.selected for r in quality_classifier.classify(docs, model).collect() if r.doc_id in want]
    assert np.mean(right) > 0.95


def test_cnn_gradients_equal_finite_differences():
    net = toxicity.random_net(np.float64)
    for b in net.biases:
        b += 0.05  # off the bend of the rectifier, where texts without words would lie
    data = toxicity.Sample([b"some words of a text that is long enough", b"you idiot", b"", b"again some words, again", b"!! ?"])
    part, y, weight = data.part(np.arange(5)), np.array([0, 1, 1, 0, 1]), np.array([0.3, 0.5, 0.2, 0.4, 0.1])
    loss, grads, used = toxicity.gradients(net, *part, y, weight)
    rng = np.random.default_rng(5)
    for k, (v, g) in enumerate(zip(net.parameters(), grads)):
        own = used if k == 0 else np.arange(len(v))
        for _ in range(25):
            i = int(rng.integers(len(own)))
            at = (own[i], *(int(rng.integers(n)) for n in v.shape[1:]))
            before = v[at]
            v[at] = before + 1e-6
            high = toxicity.gradients(net, *part, y, weight)[0]
            v[at] = before - 1e-6
            low = toxicity.gradients(net, *part, y, weight)[0]
            v[at] = before
            assert math.isclose((high - low) / 2e-6, g[(i, *at[1:])], rel_tol=1e-4, abs_tol=1e-7), k


def test_cnn_blocks_equal_whole(monkeypatch):
    net, data = toxicity.random_net(), toxicity.Sample([b"a b c d " * 40, b"", b"x", b"e f g " * 30])
    ids, begins, rows, sizes = data.part(np.arange(4))
    whole = net.maxima(ids, begins, net.embed(rows, sizes))
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(whole, net.maxima(ids, begins, net.embed(rows, sizes)), atol=1e-6)


def test_cnn_learns_from_random_weights():
    rng = np.random.default_rng(0)
    some = [b" ".join(b"w%d" % x for x in rng.integers(0, 3000, 30)) + (b" you idiot" if i % 3 == 0 else b"") for i in range(400)]
    y = np.array([int(i % 3 == 0) for i in range(400)])

    def auc(net):
        ids, begins, rows, sizes = toxicity.Sample(some).part(np.arange(400))
        p = net.probability(ids, begins, net.embed(rows, sizes))
        return (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()

    assert abs(auc(toxicity.fit(some[:200], y[:200].tolist(), epochs=0)) - 0.5) < 0.15  # nothing is put into the weights
    assert auc(toxicity.fit(some[:200], y[:200].tolist())) > 0.95


def test_toxicity_edges(spark, docs, empty):
    assert toxicity.fit([b"a"], [0]) is None
    assert {r.score for r in toxicity.score_documents(docs, None).collect()} == {0.0}
    net = toxicity.fit([b"you idiot " + str(i).encode() for i in range(40)] + [b"fine day " + str(i).encode() for i in range(40)], [1] * 40 + [0] * 40)
    assert toxicity.score_documents(docs, net).count() == len(ROWS) and toxicity.score_documents(empty, net).count() == 0
    s = {r.doc_id: r.predicted for r in toxicity.score_documents(spark.createDataFrame([(1, "what an IDIOT, you"), (2, "what a fine day")], "doc_id bigint, text string"), net).collect()}
    assert s == {1: 1, 2: 0}


def test_lm_scores(spark, docs, empty, small):
    for table in (docs, small[0]):
        rows = table.select("doc_id", "text").collect()
        count = collections.Counter()
        for r in rows:
            if not brown.held_out(r.doc_id):
                count.update(raw(r.text).lower().split())
                count[None] += 1
        n, v, seen = sum(count.values()), len(count), []
        got = brown.brown_scores(spark, table, classes=6, log=seen.append).collect()
        by = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
        want = collections.Counter()
        for r in rows:
            w = [*raw(r.text).lower().split(), None]
            want[r.doc_id, brown.held_out(r.doc_id), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
        assert by == want and all(r.score < 0 for r in got)
        rising = [x for i, x in enumerate(seen) if x > max(seen[:i], default=-math.inf)]
        assert len(rising) > 1 and rising[-1] > seen[0]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert brown.brown_scores(spark, empty).count() == 0


def bigrams(big, cls, k):
    m = np.zeros((k, k))
    np.add.at(m, (cls[:, None].repeat(len(cls), 1), cls[None].repeat(len(cls), 0)), big)
    return m


def test_gains_equal_recount():
    """The change of the likelihood by every move equals that of counting again, words that follow themselves included."""
    rng = np.random.default_rng(2)
    for words, k in ((14, 4), (9, 2), (20, 7)):
        big = (rng.integers(0, 6, (words, words)) * (rng.random((words, words)) < 0.6)).astype(float)
        cls = rng.integers(0, k, words)
        own, other = np.diag(big).copy(), big - np.diag(np.diag(big))
        prior, after = (np.stack([np.bincount(cls, x[w], k) for w in range(words)]) for x in (other.T, other))
        m = bigrams(big, cls, k)
        got = brown.gains(m, cls, prior, after, own)
        for w in range(words):
            for b in range(k):
                c = cls.copy()
                c[w] = b
                assert abs(brown.likelihood(bigrams(big, c, k)) - brown.likelihood(m) - got[w, b]) < 1e-6


def test_exchange_takes_the_best_move():
    """From the sparse counts that ranges keep; words that occur once are looked up by case."""
    rng = np.random.default_rng(3)
    tokens, k = np.append(rng.integers(0, 60, 400), np.arange(60, 160)), 5
    rng.shuffle(tokens)
    cls, n = rng.integers(0, k, 160), 2 * k + 1
    big = np.zeros((160, 160))
    np.add.at(big, (tokens[:-1], tokens[1:]), 1)
    big[tokens[-1], tokens[0]] += 1  # a ring, so that each word has as many before as after it
    m = bigrams(big, cls, k)
    width, context, number = [], [], []
    for w in range(160):
        counts = np.concatenate([np.bincount(cls, big[:, w], k), np.bincount(cls, big[w], k), [big[w, w]]])
        hit = np.flatnonzero(counts)
        width.append(len(hit))
        context += hit.tolist()
        number += counts[hit].astype(int).tolist()
    best = brown.exchange(m, cls, np.array(width, np.uint8), np.array(context), np.array(number))
    at = np.cumsum(width) - width
    assert sum(x == 2 and number[a] == number[a + 1] == 1 for x, a in zip(width, at)) > 90 and n == 11
    for w in range(160):
        value = []
        for b in range(k):
            c = cls.copy()
            c[w] = b
            value.append(brown.likelihood(bigrams(big, c, k)) if width[w] else 0.0)
        assert value[best[w]] >= max(value) - 1e-6, w


def test_brown_guards(spark, docs):
    for classes in (1, 128):
        with pytest.raises(ValueError, match="classes"):
            brown.brown_scores(spark, docs, classes=classes)


def subsequences(hashes, seed):
    keys = substring_dedup.stir(hashes ^ seed)
    return {(i, j): i + int(keys[i : j + 1].argmin()) for i in range(len(keys)) for j in range(i + substring_dedup.LEAST - 1, len(keys))}


def test_compact_windows_partition_all_subsequences():
    hashes = substring_dedup.stir(np.arange(150, dtype=np.uint64) + np.uint64(5))
    for seed in substring_dedup._SEEDS[:2]:
        want = subsequences(hashes, seed)
        s, c, r = substring_dedup.windows(hashes, np.array([0]), np.array([len(hashes)]), seed)
        got = {(i, j): int(k) for a, k, b in zip(s, c, r) for i in range(a, k + 1) for j in range(max(k, i + substring_dedup.LEAST - 1), b + 1)}
        assert got == want


def test_substring_dedup(spark, docs, empty, small):
    got = {r.doc_id: r for r in substring_dedup.substring_duplicates(spark, docs).collect()}
    assert got[9].n_links == got[10].n_links == 1 and got[10].class_id == 9 and got[7].class_id == 6
    assert [p.partner for p in got[10].passages] == [9] and got[6].n_copies == 0 and (got[10].passages[0].start_word, got[10].passages[0].end_word) == (3, 3 + len(PROSE.split()))
    assert got[1].n_links == 0 and got[1].class_id == 1
    assert substring_dedup.substring_duplicates(spark, empty).count() == 0
    rows = small[0].collect()
    where = collections.defaultdict(set)
    for r in rows:
        w = raw(r.text).lower().split()
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(r.doc_id)
    shared = set().union(*(x for x in where.values() if len(x) > 1), set())
    found = substring_dedup.substring_duplicates(spark, small[0]).collect()
    linked, cls = {r.doc_id for r in found if r.n_links}, {r.doc_id: r.class_id for r in found}
    assert shared <= linked and all(len({cls[d] for d in x}) == 1 for x in where.values())


def test_meeting_is_likely_at_the_least_similarity():
    k, p = substring_dedup.HASHES, substring_dedup.SIMILARITY
    assert sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(substring_dedup.FEWEST, k + 1)) > 0.99


def test_fragments_hide_no_passage(spark):
    """Earlier rows that hold only a fragment of a passage, few or many of them, with exact and with similar copies of the whole."""
    rng = np.random.default_rng(11)
    some = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, want = [], {"exact": [], "similar": []}
    put = lambda words: rows.append((len(rows), " ".join(some(30) + words + some(30)))) or len(rows) - 1
    for group in range(60):
        exact, crowd = group % 2 == 0, (1, 3, 14)[group % 3]
        passage = some(50 if exact else 94)
        for _ in range(crowd if exact else min(crowd, 3)):
            put(passage[1:49] if exact else passage[20:65])
        first, other = put(passage), [*passage]
        if not exact:
            other[30], other[60] = some(2)
            a, b = ({tuple(x[i : i + 5]) for i in range(90)} for x in (passage, other))
            assert len(a & b) / len(a | b) == 0.8
        want["exact" if exact else "similar"].append((first, put(other)))
    docs = spark.createDataFrame(rows, "__row bigint, text string").repartition(3)
    found = {(r.other, r.row) for r in substring_dedup.passages(spark, docs)[0].select("row", "other").collect()}
    words = [x.split() for _, x in rows]
    grams = [{tuple(w[i : i + 50]) for i in range(len(w) - 49)} for w in words]
    brute = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if grams[i] & grams[j]}
    assert set(want["exact"]) <= brute and brute <= found
    print("similar copies found", np.mean([x in found for x in want["similar"]]))
    assert np.mean([x in found for x in want["similar"]]) >= 0.9


def test_near_passages_equal_brute_force(spark):
    """Every pair of texts with passages of similarity 0.8 or more, planted with edits, copies, shared boilerplate and repeats inside a text."""
    rng = np.random.default_rng(12)
    some = lambda n: [f"u{x}" for x in rng.integers(0, 1 << 40, n)]
    line, rows, want = some(30), [], []
    put = lambda words: rows.append((len(rows), " ".join(words))) or len(rows) - 1
    for g in range(60):
        passage = some(int(rng.integers(60, 140)))
        other = [*passage]
        for at in rng.choice(np.arange(5, len(other) - 5), int(rng.integers(0, 1 + len(passage) // 60)), replace=False):
            other[at] = some(1)[0]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (passage, other))
        assert len(a & b) / len(a | b) >= 0.8
        x, y = put(some(20) + line + passage + some(25)), put(some(10) + other + line + some(15))
        want.append((x, y))
        put(rows[x][1].split())  # a copy
    clean = [put(some(150)) for _ in range(40)]
    short = [put(["few"] * 10) for _ in range(2)]
    twice = some(70)
    own = put(some(30) + twice + some(40) + twice + some(9))
    periodic = put(some(7) * 60)
    got = {r.doc_id: r for r in substring_dedup.substring_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    partners = lambda i: {p.partner for p in got[i].passages or []}
    met = [got[x].class_id == got[y].class_id == x and (x in partners(y) or y in partners(x)) for x, y in want]
    assert np.mean(met) >= 0.98, np.mean(met)
    assert all(got[x].n_copies == 1 and got[x + 2].class_id == got[x].class_id for x, _ in want)
    assert all((got[i].class_id, got[i].n_links) == (i, 0) for i in [*clean, *short, own, periodic])
    assert [(p.partner, p.start_word, p.end_word, p.other_start_word, p.other_end_word) for p in got[own].passages] == [(own, 140, 210, 30, 100)]
    assert got[periodic].passages and all(p.partner == periodic and p.other_end_word <= p.start_word for p in got[periodic].passages)


def test_confirm_is_fast_on_one_shingle():
    began = time.time()
    a = np.zeros(200_000, np.uint64)
    assert substring_dedup.confirm(a, a)
    assert time.time() - began < 20


def test_row_numbers_outlive_a_new_file_split(spark, tmp_path, monkeypatch):
    """Between two steps the cluster changes, so that the same files are cut otherwise."""
    rows = [(i, f"{PROSE} {'copy' if i % 3 else i} " * 2, "ab"[i % 2]) for i in range(24)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6).write.parquet(path)
    size = iter(range(1000))

    def change():
        spark.conf.set("spark.sql.files.maxPartitionBytes", ("1k", "128m")[next(size) % 2])

    def changing(*given):
        change()
        return common.stage(*given)

    def run(operator):
        out = operator(spark, spark.read.parquet(path))
        change()
        return out.collect()

    for module in (exact_dedup, simhash, mixing, substring_dedup):
        monkeypatch.setattr(module, "stage", changing)
    copies = {r[0] for r in rows if r[0] % 3}
    try:
        for _ in range(2):
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            change()
            assert sorted(r.doc_id for r in run(exact_dedup.keep_first_copies)) == sorted({r[0] for r in rows} - copies | {1})
            taken = collections.Counter(r.doc_id for r in run(mixing.repeat_to_mix))
            assert taken == {r.doc_id: r.taken // r.size for r in mixing.mix(spark, spark.read.parquet(path)).collect() if r.taken}
            fp = [fingerprint(raw(r[1])) for r in rows]
            assert sorted(r.doc_id for r in run(simhash.keep_leaders)) == sorted(set(components(fp)))
            for r in run(substring_dedup.substring_duplicates):
                assert r.class_id == 0 and r.n_links >= (r.doc_id % 3 > 0) * 15
        index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
        for k in range(2):  # the second time as a retry of the same batch
            change()
            assert sum(r.kept for r in exact_dedup.exact_dedup(spark, spark.read.parquet(path), index, "one", retry=k > 0).collect()) == len(rows) - len(copies) + 1
        index.drop()
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")


CLASHING = {"__row": "7", "__times": "8", "__copy": "9", "IDS": "'x'", "Decoded": "'z'", "doc": "1", "y": "2", "fits": "true", "size": "-1", "copies": "-2", "digest": "'d'", "fp": "3", "block": "4", "score": "0.5", "n": "5"}


def test_clashing_names_and_shuffled_input(spark, docs, small):
    """Columns named like those that operators add pass through every stage unchanged, also if the input has been shuffled."""
    import corpus_pipeline

    table = docs.selectExpr("*", *[f"{v} AS `{k}`" for k, v in CLASHING.items()]).repartition(3, "source")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, table, DATA)
        assert out.columns == table.columns, name
        got = out.collect()
        assert got and {tuple(r[k] for k in CLASHING) for r in got} == {tuple(r[k] for k in CLASHING) for r in table.limit(1).collect()}, name
        texts = {(r.doc_id, r.text, r.source) for r in docs.collect()}
        assert {(r.doc_id, r.text, r.source) for r in got} <= texts, name
    out = bpe.encode_documents(table, vocabulary())
    assert [c.lower() for c in out.columns].count("ids") == 1 and {r["__row"] for r in out.collect()} == {7}
    net, model = toxicity.fit([b"a bad"] * 9 + [b"a good"] * 9, [1] * 9 + [0] * 9), quality_classifier.fit([b"a", b"b"] * 9, [0, 1] * 9)
    for found in (toxicity.score_documents(table, net), quality_classifier.classify(table, model), exact_dedup.exact_dedup(spark, table), simhash.near_duplicates(spark, table), mixing.mix(spark, table), quality_rules.quality_rules(table), bpe.digest_documents(table, vocabulary()), token_counts.count_edited(spark, table, vocabulary()), substring_dedup.substring_duplicates(spark, table), brown.brown_scores(spark, table, classes=3)):
        assert found.count() == len(ROWS)


def test_pipeline_equals_brute_force(spark):
    """The rows of run(), stage by stage in plain Python; only the classifier's weights are taken from its own fit."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    table, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = table.select("doc_id", "source", "text").collect()
    model = quality_classifier.train(spark, table, labels)

    def tail(text):
        words = text.split()
        z = sum(float(model.weights[a]) + float(model.weights[b]) for a, b in map(quality_classifier.features, words))
        z += float(model.weights[quality_classifier.REPEAT]) * sum(a == b for a, b in zip(words, words[1:]))
        return 1 / (1 + math.exp(model.thresholds[0] - z / (len(words) + quality_classifier.SHRINK)))

    assert len(model.grades) == 3 and model.thresholds[0] < model.thresholds[1]
    rows = [r for r in rows if tail(raw(r.text)) >= 0.5]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(rb"[\x20\x09-\x0D]", b"", raw(r.text))].append(r)
    rows = [min(g, key=lambda r: (-len(r.text or ""), r.doc_id)) for g in groups.values()]
    label = components([fingerprint(raw(r.text)) for r in rows])
    near = collections.defaultdict(list)
    for r, k in zip(rows, label):
        near[k].append(r)
    rows = [min(g, key=lambda r: r.doc_id) for g in near.values()]
    size = {r.doc_id: len(WORD.findall(raw(r.text))) for r in rows}
    per = collections.Counter()
    for r in rows:
        per[r.source] += size[r.doc_id]
    names = sorted(per)
    weight, target, left, open_ = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, sum(per.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] >= 3 * per[s] * total]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 3 * per[s] for s in over}
        open_ -= set(over)
        left = sum(per.values()) - sum(target.values())
    want = collections.Counter()
    lib = Tokenizer.from_file(vocabulary())
    lib.no_padding()
    lib.no_truncation()
    for r in rows:
        rate = target[r.source] / per[r.source] if per[r.source] else 0
        draw = int(hashlib.md5(f"{r.doc_id}:{mixing.SEED}".encode()).hexdigest()[:8], 16) / 2**32
        times = int(rate) + (draw < rate - int(rate)) if size[r.doc_id] else 1
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        if times:
            want[r.doc_id, r.source, tuple(ids), len(ids), lib.decode(ids, skip_special_tokens=False)] += times
    got = collections.Counter((r.doc_id, r.source, tuple(r.ids), r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want and len(want) > 50


def test_pipeline(spark, tmp_path, docs, empty, small):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "ids"} <= set(out.columns) and 0 < out.count()
    for table in (docs, empty):
        at = table
        for name, apply in corpus_pipeline.STAGES[:-1]:
            at = apply(spark, at, DATA)
            assert at.columns == table.columns, name
        assert (corpus_pipeline.STAGES[-1][1](spark, at, DATA).count() > 0) == (table is docs)
