"""Periodic runs, importance resampling and disguised personal data against brute force."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from loomgraph.llm import periodic_runs, private_data, radix, resampling
from loomgraph.llm.queries import op11_periodic_runs, op12_importance_resampling, op13_private_data

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, `rank` string, `spans` string, `__row` string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def folder(spark, tmp_path, rows, benchmark=("target words here",)):
    table(spark, rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(benchmark)], "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


# operator 11


def lyndon_by_definition(s):
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def runs_by_definition(x, least=12):
    out = set()
    for p in range(1, len(x)):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            size = j - i + p
            if size >= max(least, 2 * p) and not any(x[i : i + size - q] == x[i + q : i + size] for q in range(1, p)):
                out.add((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.randint(1, 80), rng.choice([1, 2, 2, 3, 4, 30])
    s = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 8)
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
    return s


def test_lyndon_array_equals_definition():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(1, 20))]
        assert periodic_runs.lyndon_array(s) == lyndon_by_definition(s)


def test_runs_equal_definition():
    rng = random.Random(2)
    for _ in range(400):
        s = some_words(rng)
        assert periodic_runs.runs_of(np.array(s, np.int64)) == runs_by_definition(s)


def test_run_lengths_do_not_square():
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    began = time.time()
    assert periodic_runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert periodic_runs.runs_of(np.array(b, np.int64))
    assert time.time() - began < 20


def planted_by_definition(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(f"w{x}é" for x in some_words(rng))) for i in range(400)]
    rows += [(None, "a b " * 20), (500, None), (501, ""), (502, " \t\x0b\n"), (503, "nb sp " * 15), (504, "y " * 9_000), (3, rows[3][1]), (505, "a b c d e f " * 2)]
    got = op11_periodic_runs(spark, folder(spark, tmp_path, rows)).collect()
    want = []
    for doc_id, text in rows:
        w = planted_by_definition(doc_id, text)
        runs = [(0, 9_000, 1)] if doc_id == 504 else runs_by_definition(w)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    ours = [tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in got]
    assert sorted(map(str, ours)) == sorted(map(str, want))


# operator 12


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled_by_definition(rows, benchmark):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)
    for counts, texts in ((s, [x for _, x in rows]), (t, benchmark)):
        for x in texts:
            for f in features(x)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(s.sum() + 10_000) / (float(s[b] + 1) * float(t.sum() + 10_000)))) for b in range(10_000)]
    out = []
    for doc_id, text in rows:
        n, fs = features(text)
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * 5 // 100]
    return sorted(str((*r[:4], next((k + 1 for k, x in enumerate(drawn) if x is r), None))) for r in out)


def test_resampling_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gäm", "x" * 300, "日本", "d1", "e-f", "target", "words", "here", "ÀB"]
    rows = [(i, rng.choice([" ", ".", "\n"]).join(rng.choice(words) for _ in range(rng.choice([3, 19, 20, 21, 60])))) for i in range(600)]
    rows += [(None, "target words here " * 10), (-5, "same " * 30), (-5, "same " * 30), (700, None), (701, ""), (702, "..."), (703, "alpha beta " * 15_000)]
    benchmark = ("Target words, here", None, "gäm x")
    got = op12_importance_resampling(spark, folder(spark, tmp_path, rows, benchmark)).collect()
    assert sorted(str(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank"))) for r in got) == resampled_by_definition(rows, list(benchmark))


def test_radix_ranks_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(radix, "BLOCK", 50)
    rng = random.Random(5)
    rows = [(i, rng.choice([7, 7, 7, rng.randint(-(1 << 62), 1 << 62), rng.randint(-9, 9)]), rng.choice([-(1 << 63), (1 << 63) - 1, rng.randint(0, 99)])) for i in range(700)]
    df = spark.createDataFrame(rows, "row bigint, a bigint, b bigint").repartition(5)
    got = {r["row"]: r["rank"] for r in radix.radix_ranks(spark, df, [df["a"], df["b"]], "row").collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[0])))}
    same = spark.createDataFrame([(i, 1) for i in range(120)], "row bigint, a bigint")
    assert sorted(r["rank"] for r in radix.radix_ranks(spark, same, [same["a"]], "row").collect()) == list(range(1, 121))


# operator 13


def base_by_definition(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(d[::-1])) % 10 == 0
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return out


MAIL, CARD, PHONE, ADDRESS = "hein.19@mail5.example.com", "4785380592391139", "+1 (743) 555-3824", "152.143.123.131"
DISGUISES = [
    ("email", x) for x in (
        "hein.19 [at] mail5 [dot] example [dot] com", "hein.19(at)mail5(dot)example(dot)com", "hein.19 AT mail5 DOT example DOT com", "hein.19 at mail5.example.com", "hein.19＠mail5．example．com",
        "hеin.19@mаil5.exаmple.com", "hein.19@mail5 dot example dot com", "hein dot 19 at mail5 dot example dot com", "hein.19 @ mail5 . example . com", "hein.19&#64;mail5&#46;example&#46;com", "hein.19%40mail5.example.com",
        "hein.19 {at} mail5 {punkt} example {punkt} com", "hein.19_at_mail5_dot_example_dot_com", "h​ein.19@mail5.exam­ple.com", "𝐡𝐞𝐢𝐧.19@mail5.example.com", "hein[.]19[@]mail5[.]example[.]com",
    )
] + [
    ("card", x) for x in ("four seven eight five three eight zero five nine two three nine one one three nine", "4785 3805 9239 one one three nine", "４７８５３８０５９２３９１１３９", "4785380592391l39", "478538O592391139", "4785 3805 9239 1139", "vier sieben acht fünf drei acht null fünf neun zwei drei neun eins eins drei neun", "٤٧٨٥٣٨٠٥٩٢٣٩١١٣٩", "4785З80592З9іiЗ9", "Four-seven-eight-five three-eight-zero-five nine-two-three-nine double one three nine")
] + [
    ("phone", x) for x in ("plus one seven four three five five five three eight two four", "+1 (seven four three) 555-three eight two four", "+1 (743) 555-38２4", "+ one seven four three triple five three eight two four", "＋1 743 555 3824", "+1 (743) 555‑3824")
] + [("ip", x) for x in ("152[.]143[.]123[.]131", "152 dot 143 dot 123 dot 131", "one five two dot one four three dot one two three dot one three one", "152。143。123。131", "152(dot)143(dot)123(dot)131", "l52.143.123.13l")]
CLEAN = ["look at example.com", "he looked at the dot on the wall. Then he", "one two three four", "there is one two things", "sieben vier", "a point at the top. com", "5 @ 3.50 each", "Année 2024 à Paris, déjà vu – 12 000 000", "version 1.2 dot 3", "see (at) the end. Then on", "+12 one", "плохо в мире", "at one point it is", "B2B 1O1 S5", "x_at_y", ""]


@pytest.mark.parametrize(("kind", "hidden"), DISGUISES)
def test_disguised_identifiers_are_found_in_place(kind, hidden):
    """Each in front of, between and behind other characters, some of them longer once rewritten."""
    digits = re.sub("[^0-9]", "", {"card": CARD, "phone": PHONE}.get(kind, ""))
    for before, behind in (("", ""), ("see ", " now"), ("Ⅷ ​ ｘ: ", ", ok."), ("é\n", "\nß")):
        text = before + hidden + behind
        found = [(a, b, value) for k, a, b, base, value in private_data.found_in(text) if k == kind and not base]
        assert (len(before), len(before) + len(hidden)) in [x[:2] for x in found], (text, found)
        value = next(x[2] for x in found if x[0] == len(before))
        assert value == {"email": MAIL, "ip": ADDRESS}.get(kind, value) and (not digits or re.sub("[^0-9]", "", value) == digits)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays_clean(text):
    assert [x for x in private_data.found_in(text) if not x[3]] == []


def test_base_equals_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        s = "".join(rng.choice("a1@.-+ 2b(9%_é") for _ in range(rng.randint(0, 40)))
        assert [x[:3] for x in private_data.found_in(s) if x[3]] == base_by_definition(s)


def test_offsets_map_back_through_chains():
    r = private_data.Rewritten("ab--cd==ef")
    r.rewrite([(2, 4, "X"), (6, 8, "YYY")]).rewrite([(0, 2, ""), (4, 6, "z")])
    # abXcdYYYef -> Xcz + rest: places map to the whole of what was replaced
    assert r.text == "XczYYef" and [r.source(k, k + 1) for k in range(7)] == [(2, 4), (4, 5), (5, 8), (6, 8), (6, 8), (8, 9), (9, 10)]


@pytest.mark.parametrize("unit", ["a", "1", "+1 ", "a@", "1.", " ", "one ", "%40", "a at ", "l", "1 dot ", "a.b@c.d@", "(", "-", "at [dot] ", "double ", "​", "plus "])
def test_long_texts_take_linear_time(unit):
    took = []
    for n in (40_000, 160_000):
        began = time.process_time()
        private_data.found_in(unit * (n // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_private_data_query(spark, tmp_path):
    rows = [(k, f"word {x} word {MAIL} or {ADDRESS}") for k, (_, x) in enumerate(DISGUISES)] + [(100 + k, x) for k, x in enumerate(CLEAN)]
    rows += [(None, MAIL), (200, None), (1, rows[1][1]), (201, f"é {CARD}, {PHONE} " * 3000)]
    got = op13_private_data(spark, folder(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    base = {(d, t or ""): base_by_definition(t) for d, t in rows}
    want = sorted(str((d, *(sum(k == kind for kind, *_ in spans) for k in private_data.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())) for (d, _), spans in ((key, base[key]) for key in ((d, t or "") for d, t in rows)))
    assert sorted(str((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in got) == want
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        own = next(s for (d, _), s in base.items() if d == r.doc_id)
        assert {f"{k}:{a}:{b}" for k, a, b in own} <= set(spans)
        assert (len(spans) > len(own)) == (r.doc_id is not None and r.doc_id < len(DISGUISES))


def test_given_texts_hold_no_disguise(spark):
    """The given tables hold plain identifiers only, so nothing is added to them."""
    for r in op13_private_data(spark, DATA).collect():
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(r.spans.split(",") if r.spans else [])


@pytest.mark.parametrize("query", [op11_periodic_runs, op12_importance_resampling, op13_private_data])
def test_empty_tables(spark, tmp_path, query):
    assert query(spark, folder(spark, tmp_path, [], ())).count() == 0


# substring dedup


def test_many_pairs_equal_one_by_one():
    """Pairs verified at once, with shifts, gaps, repeated shingles, nothing in common and empty sides."""
    from loomgraph.llm.substring_dedup import confirm, confirm_many

    rng = np.random.default_rng(3)
    pairs = [(np.empty(0, np.uint64), np.arange(60, dtype=np.uint64))]
    for _ in range(1500):
        n, kinds = int(rng.integers(0, 300)), int(rng.choice([20, 1 << 39]))
        a = rng.integers(0, kinds, n).astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 6))):
            if len(b) > 5:
                k, m = int(rng.integers(0, len(b))), int(rng.integers(1, 40))
                new = rng.integers(0, 1 << 39, m).astype(np.uint64)
                b = np.concatenate([b[:k], *([new] if rng.random() < 0.7 else []), b[k + (m if rng.random() < 0.7 else 0) :]])
        pairs.append((a, b))
    want = [confirm(a, b) for a, b in pairs]
    assert confirm_many(pairs) == want and sum(map(len, want)) > 100 and confirm_many([]) == []


def test_word_hashes_equal_words(monkeypatch):
    from loomgraph.llm import substring_dedup

    some = [b"", b" \t", b"One two\x0bTHREE four\nfive six", b"one two three four five", "é \xa0ß x y z five".encode(), b"a" * 5000, b"one two three four five"]
    whole = substring_dedup.sequences(some)
    monkeypatch.setattr(substring_dedup, "PIECE", 16)  # cut into pieces, never inside a word
    cut = substring_dedup.sequences(some)
    assert all((a == b).all() for a, b in zip(whole, cut))
    hashes, begins, ends = whole
    first = [hashes[b] if e > b else None for b, e in zip(begins, ends)]
    assert first[2] == first[3] == first[6] is not None and first[4] not in (None, first[2]) and first[0] is first[1] is first[5] is None
    words = [w for x in some for w in x.lower().split()]
    flat = np.concatenate([substring_dedup.word_hashes(x.lower())[0] for x in some])
    assert len({*zip(words, flat.tolist())}) == len(set(words)) == len(set(flat.tolist()))


def test_near_passages_beside_frequent_ones(spark):
    """Passages half of which are boilerplate that 60 other texts have as well, so that their signatures have many surroundings: all pairs at 0.84 and above are found, clean texts are not linked."""
    from loomgraph.llm.substring_dedup import substring_duplicates

    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    boiler = [word() for _ in range(45)]
    rows = [(k, " ".join([word() for _ in range(80)] + boiler + [word() for _ in range(80)])) for k in range(60)]
    pairs = []
    for k in range(30):
        passage = boiler[:30] + [word() for _ in range(60)]
        other = passage[:]
        other[60] = word()  # five shingles differ of 86
        a, b = 1000 + 2 * k, 1001 + 2 * k
        rows += [(d, " ".join([word() for _ in range(70)] + p + [word() for _ in range(70)])) for d, p in ((a, passage), (b, other))]
        pairs.append((a, b))
    rows += [(5000 + k, " ".join(word() for _ in range(200))) for k in range(20)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in substring_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()}
    assert all(got[a].class_id == got[b].class_id == a for a, b in pairs)
    assert all(got[d].n_links == 0 and got[d].class_id == d for d, _ in rows if d >= 5000)


# quality rules and LM scores, whole tables against a plain recount


def kept_by_definition(text):
    import zstandard

    size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x))
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    inside = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    if len(words) < 50 or 100 * len(inside) > 50 * len(words):
        return False
    limits = {0: (0.90, 3.0), 512: (1.15, 3.2), 2048: (1.35, 3.5), 8192: (1.5, 3.8), 32768: (1.55, 4.2)}
    low, high = limits[max(k for k in limits if len(raw) >= k)]
    if not low <= len(raw) / size(raw) <= high:
        return False
    if len(raw) <= 4096:
        return True
    places = list(range(0, len(raw) - 4096, 4096)) + [len(raw) - 4096]
    odd = sum(not 1.25 <= 4096 / size(raw[i : i + 4096]) <= 4.0 for i in places)
    return odd <= 0.25 * len(places)


def test_all_quality_verdicts_equal_a_recount(spark):
    from loomgraph.llm.quality_rules import quality_rules

    rng = random.Random(8)
    prose = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    junk = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") + (" " if rng.random() < 0.1 else "") for _ in range(n))
    words = " ".join(prose).split()
    made = [" ".join(rng.choice(words) for _ in range(rng.choice([60, 400, 1500, 6000]))) for _ in range(40)]
    made += [a[: rng.randrange(8000)] + " " + junk(rng.choice([300, 4000, 9000])) for a in made[:25]] + [junk(6000), "same line here\n" * 900 + made[0], "", None]
    rows = list(enumerate(prose + made))
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    want = {d: kept_by_definition(t) for d, t in rows}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_lm_scores_equal_a_plain_sum(spark, tmp_path, monkeypatch):
    """The classes that the clustering ended with are taken from its tasks; transitions, counts and every token's probability are counted again from the texts."""
    import pickle
    from collections import Counter

    from loomgraph.llm import brown

    seen = str(tmp_path / "seen")
    tmp_path.joinpath("seen").mkdir()
    original, given = brown.score, []

    def spy(matrix, n, v, once):
        given.append(matrix)
        run = original(matrix, n, v, once)

        def also(blocks, news):
            for block in blocks.to_pylist():
                lengths, cls, _ = brown.unpack(block, news.to_pylist())
                with open(f"{seen}/{block['block']}", "wb") as f:
                    pickle.dump((block["doc_ids"], lengths.tolist(), np.frombuffer(block["tokens"], "<i4").tolist(), np.asarray(cls).tolist()), f)
            return run(blocks, news)

        return also

    monkeypatch.setattr(brown, "score", spy)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.score for r in brown.brown_scores(spark, docs, classes=7).collect()}
    text = {r.doc_id: r.text.encode().lower().split() + [None] for r in docs.collect()}
    cls = {}
    for f in (tmp_path / "seen").iterdir():
        ids, lengths, tokens, classes = pickle.loads(f.read_bytes())
        at = 0
        for d, n in zip(ids, lengths):
            assert n == len(text[d])
            for w, t in zip(text[d], tokens[at : at + n]):
                assert cls.setdefault(w, classes[t]) == classes[t] or brown.held_out(d)
            at += n
    train = {d: w for d, w in text.items() if not brown.held_out(d)}
    count = Counter(w for ws in train.values() for w in ws)
    pairs = Counter((cls[a], cls[b]) for ws in train.values() for a, b in zip([None, *ws], ws))
    matrix = np.zeros((7, 7))
    for (a, b), k in pairs.items():
        matrix[a, b] = k
    assert (given[0] == matrix).all()
    n, v = sum(count.values()), len(count)
    in_class = Counter()
    for w, k in count.items():
        in_class[cls[w]] += k
    miss = min(max(sum(k == 1 for k in count.values()) / n, 1 / (n + v + 1)), 0.5)
    for d, ws in text.items():
        total = 0.0
        for a, b in zip([None, *ws], ws):
            if not count[b]:
                total += math.log10(miss)
                continue
            share = in_class[cls[b]] / n
            step = (pairs[cls[a], cls[b]] + brown.SMOOTH * share) / (sum(pairs[cls[a], k] for k in range(7)) + brown.SMOOTH) if count[a] else share
            total += math.log10((1 - miss) * (brown.MIX * step * count[b] / in_class[cls[b]] + (1 - brown.MIX) * count[b] / n))
        assert math.isclose(total, got[d], rel_tol=1e-9), d


def test_a_third_of_all_rows_alike(spark):
    """One text holds a third of the rows: groups, components and classes are those of any other group, and nothing is lost."""
    from loomgraph.llm import exact_dedup, simhash, substring_dedup

    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(70))
    hot = text()
    rows = [(k, hot if k % 3 == 0 else text()) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = exact_dedup.dedup_in_batches(spark, docs).collect()
    assert sum(r.kept for r in got) == 601 and {(r.keep_id, r.group_size) for r in got if r.doc_id % 3 == 0} == {(0, 300)}
    near = simhash.near_duplicates(spark, docs).collect()
    assert {r.component_id for r in near if r.doc_id % 3 == 0} == {0} and len(near) == 900
    spans = substring_dedup.substring_duplicates(spark, docs).collect()
    assert {(r.class_id, r.n_links, r.n_copies) for r in spans if r.doc_id % 3 == 0} == {(0, 299, 299)} and all(r.n_links == 0 for r in spans if r.doc_id % 3)
