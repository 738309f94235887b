"""LM scoring with Brown classes (operator 10): a class-based bigram model whose classes exchange clustering finds.

P(word | before) = (1 - m) (L P(class | class before) N(word) / N(class) + (1 - L) N(word) / N), and m for the one
unknown word, where m is the share of training tokens that occur once (Good-Turing). Class transitions are smoothed towards the class's share.

How it runs. Documents are packed into blocks of about BLOCK tokens: word numbers of the block, and the block's distinct words as
sorted 64-bit hashes. Blocks are written once, as a table bucketed by block, so that what is sent to blocks later is joined without moving
the tokens again. Words live in ranges of their hash; a frequent word arrives at its range once
per block, pre-counted, so it makes no hot group. A range reads its rows as a sorted stream, one block's after another's, and keeps only its own words and their counts, so its
memory is that of its words, however many blocks there are. Each round, blocks send every word's counts by the class before and after it
to the word's range, ranges add them up, and words move to the class with the largest exact change of the class-bigram likelihood, given
the other words' classes (the exchange algorithm, the moving words of a round against the same counts; the others rest). Only the matrix of class
bigrams, CLASSES squared numbers, passes through the driver. All counts cover all training documents, whatever the size.

Rounds go on until one gains less than TOLERANCE of log10 likelihood per training token. Words that move at once can overshoot: a round
that does not raise the likelihood is taken back, and half as many words move from there. The most frequent words begin in classes of
their own, as in Brown's algorithm, all others in the last one, from which they move out by their contexts.

Words are told apart by 64-bit hashes (XXH64): among 10^8 distinct words the chance of any collision is 3 in 10 000.

Defined results: null text counts as empty, which has the end token only; a null doc_id is not held out. Without
training tokens every token is unknown. Repeated rows count and score each on their own. Of classes with equal gain the first is taken; words of
equal count are ranked by their hash. Long texts are one document in one block, whole. An empty table gives an empty result. Other columns are not
read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Memo, bucketed, slices, small_batches, stage, texts, unstage

CLASSES = 24
#: A round that gains less (log10 of the likelihood per training token) is the last.
TOLERANCE = 0.01
#: The share of words that move in a round at first, and the least to which it is halved.
MOVING, FEWEST_MOVING = 0.75, 0.05
BLOCK = 400_000
FOLDS, HELD = 7, 2
#: Weight of the class model against the plain word share, and of the class's share against its transitions (in tokens).
MIX, SMOOTH = 0.95, 20.0
END = b" "  # no word has a space

BLOCKS = "block bigint, doc_ids array<bigint>, lengths binary, held binary, tokens binary, words binary, counts binary"
#: Rows that ranges get, in the order of block and kind. Block OWN: what the range keeps (OWN rows: words and counts, or classes, or classes with the
#: counts of their contexts). Other blocks: PLACE: where the block's words are among the range's; NEWS: what a block has counted.
OWN, PLACE, NEWS = -1, 0, 1
ROWS = "range int, block bigint, kind int, at binary, count binary, class binary, width binary, context binary, number binary, matrix array<double>"
COLUMNS = [x.split()[0] for x in ROWS.split(", ")]
#: A range adds up what blocks have sent whenever so many counts are waiting.
WAITING = 2_000_000
#: Rows that go to Python at once; one holds what a block and a range tell each other, tens of kilobytes.
ROWS_AT_ONCE = 500


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well when most are small."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplane(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def rising(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=0).astype("<i4"))


def unrise(raw: bytes) -> np.ndarray:
    return np.cumsum(unplane(raw, "<i4").astype(np.int64))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS: per document its tokens, each document ending with END."""
    number = TaskContext.get().partitionId() << 32
    ids, lengths, held, parts, total = [], [], [], [], 0
    local = Memo(lambda w: len(local))
    end = local[END]

    def block() -> pa.RecordBatch:
        nonlocal number, ids, lengths, held, parts, total
        words = np.array([xxhash.xxh64_intdigest(w) for w in local], np.uint64)
        order = np.argsort(words)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        tokens = place[np.concatenate(parts)]
        learn = np.repeat(~np.array(held), lengths)
        counts = np.bincount(tokens[learn], minlength=len(words))
        row = {"block": [number], "doc_ids": [ids], "lengths": [np.array(lengths, "<i4").tobytes()], "held": [np.array(held).tobytes()], "tokens": [tokens.astype("<i4").tobytes()], "words": [words[order].tobytes()], "counts": [counts.astype("<i4").tobytes()]}
        number, ids, lengths, held, parts, total = number + 1, [], [], [], [], 0
        local.clear()
        assert local[END] == end
        return pa.RecordBatch.from_arrays([pa.array(row["block"], pa.int64()), pa.array(row["doc_ids"], pa.list_(pa.int64())), *(pa.array(row[k], pa.binary()) for k in ("lengths", "held", "tokens", "words", "counts"))], names=[*row])

    for batch in slices(batches):
        get = local.__getitem__
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
            words = text.lower().split()
            words.append(END)
            parts.append(np.fromiter(map(get, words), np.int32, len(words)))
            ids.append(doc)
            lengths.append(len(words))
            held.append(held_out(doc))
            total += len(words)
            if total >= BLOCK:
                yield block()
    if ids:
        yield block()


def row(**some) -> dict:
    return {k: some.get(k) for k in COLUMNS}


def batches_of(rows: list[dict]) -> list[pa.RecordBatch]:
    kinds = {"range": pa.int32(), "block": pa.int64(), "kind": pa.int32(), "matrix": pa.list_(pa.float64())}
    return pa.table({k: pa.array([r[k] for r in rows], kinds.get(k, pa.binary())) for k in COLUMNS}).to_batches() if rows else []


def cuts(words: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins among the sorted words."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(words, edges), [len(words)]])


def to_ranges(ranges: int):
    """A block's words (their hashes, in 'at') and their counts, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words, counts = np.frombuffer(words, np.uint64), np.frombuffer(counts, "<i4")
                at = cuts(words, ranges)
                yield from batches_of([row(range=k, block=block, kind=PLACE, at=words[a:b].tobytes(), count=planes(counts[a:b])) for k, (a, b) in enumerate(zip(at, at[1:])) if b > a])

    return run


def streamed(rows: DataFrame, ranges: int, handle) -> DataFrame:
    """Each range's rows as a stream sorted by block and kind. handle(range) gives an object whose take(row) and end() give rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or r["range"] != at:
                    out += now.end() if now else []
                    now, at = handle(r["range"]), r["range"]
                out += now.take(r)
            yield from batches_of(out)
        if now:
            yield from batches_of(now.end())

    return rows.repartition(ranges, "range").sortWithinPartitions("range", "block", "kind").mapInArrow(run, ROWS)


class Vocabulary:
    """All words of a range and their counts."""

    def __init__(self, k: int):
        self.k, self.words, self.total, self.parts, self.waiting = k, np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def take(self, r: dict) -> list:
        self.parts.append((np.frombuffer(r["at"], np.uint64), unplane(r["count"], "<i4").astype(np.int64)))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > WAITING:
            self.add()
        return []

    def add(self) -> None:
        words, at = np.unique(np.concatenate([self.words, *(x for x, _ in self.parts)]), return_inverse=True)
        total = np.bincount(at, np.concatenate([self.total, *(x for _, x in self.parts)]), len(words))
        self.words, self.total, self.parts, self.waiting = words, total.astype(np.int64), [], 0

    def end(self) -> list[dict]:
        self.add()
        return [row(range=self.k, block=OWN, kind=OWN, at=self.words.tobytes(), count=planes(self.total))]


class Places:
    """Where each block's words are among those of the range."""

    def __init__(self, k: int):
        self.k = k

    def take(self, r: dict) -> list[dict]:
        words = np.frombuffer(r["at"], np.uint64)
        if r["kind"] == OWN:
            self.words = words
            return []
        return [row(range=self.k, block=r["block"], kind=PLACE, at=rising(np.searchsorted(self.words, words)))]

    def end(self) -> list:
        return []


class Sender:
    """Sends the classes of their words to blocks, and with counts=True their counts. make(row) gives a range's classes and counts."""

    def __init__(self, k: int, make, counts: bool = False):
        self.k, self.make, self.counts = k, make, counts

    def take(self, r: dict) -> list[dict]:
        if r["kind"] == OWN:
            self.classes, self.total = self.make(r)
            return [row(range=self.k, block=OWN, kind=OWN, **{"class": self.classes.astype(np.uint8).tobytes()})]
        at = unrise(r["at"])
        return [row(range=self.k, block=r["block"], kind=PLACE, count=planes(self.total[at]) if self.counts else None, **{"class": self.classes[at].astype(np.uint8).tobytes()})]

    def end(self) -> list:
        return []


def first_classes(top: dict[int, int], classes: int):
    """The most frequent words have a class each, as in Brown's algorithm; all others begin in the last."""

    def make(own: dict) -> tuple[np.ndarray, None]:
        words = np.frombuffer(own["at"], np.uint64)
        c = np.full(len(words), classes - 1)
        for word, k in top.items():
            at = np.searchsorted(words, np.uint64(word))
            if at < len(words) and words[at] == np.uint64(word):
                c[at] = k
        return c, None

    return make


def unpack(block: dict, news: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's lengths, and the classes and counts of its words from what the ranges sent."""
    news.sort(key=lambda r: r["range"])
    classes = np.frombuffer(b"".join(r["class"] for r in news), np.uint8).astype(np.int64)
    count = np.concatenate([unplane(r["count"] or b"", "<i8") for r in news])
    return np.frombuffer(block["lengths"], "<i4").astype(np.int64), classes, count


def contexts(classes_n: int):
    """Counts of each word of a block by the class before it (codes from 0), the class after it (from classes_n) and after itself (the last code),
    over the training documents."""

    def run(blocks: pa.Table, news: pa.Table) -> pa.Table:
        out = []
        news = news.to_pylist()
        for block in blocks.to_pylist():
            lengths, cls, _ = unpack(block, news)
            tokens = np.frombuffer(block["tokens"], "<i4").astype(np.int64)
            train = ~np.frombuffer(block["held"], bool)
            learn = np.repeat(train, lengths)
            begins, last, end, n = np.cumsum(lengths) - lengths, np.cumsum(lengths) - 1, tokens[-1], 2 * classes_n + 1
            # a document is preceded by the end of one, whichever it is
            prior = np.empty_like(tokens)
            prior[1:] = tokens[:-1]
            prior[begins] = end
            inner = learn.copy()
            inner[last] = False  # what follows an end is the next document's first word, counted from there
            inner = np.flatnonzero(inner)
            first = tokens[begins[train]]
            mine, before = tokens[learn], prior[learn]
            keys = np.concatenate([mine * n + cls[before], tokens[inner] * n + classes_n + cls[tokens[inner + 1]], end * n + classes_n + cls[first], mine[mine == before] * n + n - 1])
            keys = np.bincount(keys, minlength=len(cls) * n)
            found = np.flatnonzero(keys)
            number, word, context = keys[found].astype("<i4"), found // n, (found % n).astype(np.uint8)
            width = np.bincount(word, minlength=len(cls)).astype(np.uint8)
            at_word, at_entry = 0, 0
            for r in news:
                size = len(r["class"])
                some = int(width[at_word : at_word + size].sum(dtype=np.int64))
                out.append(row(range=r["range"], block=block["block"], kind=NEWS, width=width[at_word : at_word + size].tobytes(), context=context[at_entry : at_entry + some].tobytes(), number=planes(number[at_entry : at_entry + some])))
                at_word, at_entry = at_word + size, at_entry + some
        return pa.Table.from_batches(batches_of(out))

    return run


class Gather:
    """The counts of a range's words over all blocks, and its part of the matrix of class bigrams."""

    def __init__(self, k: int, classes_n: int):
        self.k, self.classes_n, self.n = k, classes_n, 2 * classes_n + 1
        self.keys, self.numbers, self.parts, self.waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def take(self, r: dict) -> list:
        if r["kind"] == OWN:
            self.cls = np.frombuffer(r["class"], np.uint8).astype(np.int64)
        elif r["kind"] == PLACE:
            self.at = unrise(r["at"])
        else:
            keys = np.repeat(self.at, np.frombuffer(r["width"], np.uint8)) * self.n + np.frombuffer(r["context"], np.uint8)
            self.parts.append((keys, unplane(r["number"], "<i4").astype(np.int64)))
            self.waiting += len(keys)
            if self.waiting > WAITING:
                self.add()
        return []

    def add(self) -> None:
        found, at = np.unique(np.concatenate([self.keys, *(x for x, _ in self.parts)]), return_inverse=True)
        self.numbers = np.bincount(at, np.concatenate([self.numbers, *(x for _, x in self.parts)]), len(found)).astype(np.int64)
        self.keys, self.parts, self.waiting = found, [], 0

    def end(self) -> list[dict]:
        self.add()
        word, context, k = self.keys // self.n, self.keys % self.n, self.classes_n
        prior = context < k
        matrix = np.bincount(context[prior] * k + self.cls[word[prior]], self.numbers[prior], k * k)
        width = np.bincount(word, minlength=len(self.cls)).astype(np.uint8)
        return [row(range=self.k, block=OWN, kind=OWN, width=width.tobytes(), context=context.astype(np.uint8).tobytes(), number=planes(self.numbers), matrix=matrix.tolist(), **{"class": self.cls.astype(np.uint8).tobytes()})]


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """What of the log-likelihood depends on the classes: the sum of f(N(a, b)), less f(N(a, .)) and f(N(., b)), with f(x) = x log x."""
    return float(xlogx(matrix).sum() - xlogx(matrix.sum(1)).sum() - xlogx(matrix.sum(0)).sum())


def gains(matrix: np.ndarray, cls: np.ndarray, prior: np.ndarray, after: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The exact change of the likelihood by each word's move to each class, all other words staying.

    prior, after: a word's counts by the class before and after it, without those where it follows itself, whose number is own. For a move from A to B, cells of
    rows and columns A and B change. Those where they cross are taken out of the sums over contexts and put in on their own."""
    n, at = len(cls), np.arange(len(cls))
    gain, leaves, f = np.zeros((n, len(matrix))), np.zeros(n), xlogx
    for counts, m in ((after, matrix), (prior, matrix.T)):  # row B of matrix by the class after, then its column B by the class before
        word, context = np.nonzero(counts)
        if len(word):
            x, cells = counts[word, context], m.T[context]
            begins = np.flatnonzero(np.diff(word, prepend=-1))
            gain[word[begins]] += np.add.reduceat(f(cells + x[:, None]) - f(cells), begins, 0)
            mine = cells[np.arange(len(word)), cls[word]]
            leaves += np.bincount(word, f(mine - x) - f(mine), n)
    to_a, from_a, own = after[at, cls][:, None], prior[at, cls][:, None], own[:, None]
    aa, bb, ab, ba = matrix[cls, cls][:, None], np.diag(matrix)[None], matrix[cls], matrix.T[cls]
    gain -= f(ba + to_a) + f(bb + after) + f(ab + from_a) + f(bb + prior) - f(ba) - f(ab) - 2 * f(bb)
    gain += leaves[:, None] - (f(aa - to_a) + f(ab - after) + f(aa - from_a) + f(ba - prior) - 2 * f(aa) - f(ab) - f(ba))
    gain += f(aa - to_a - from_a - own) + f(bb + after + prior + own) + f(ab - after + from_a) + f(ba - prior + to_a) - f(aa) - f(bb) - f(ab) - f(ba)
    for total, x in ((matrix.sum(1), after.sum(1)[:, None] + own), (matrix.sum(0), prior.sum(1)[:, None] + own)):
        gain -= f(total + x) - f(total) + f(total[cls][:, None] - x) - f(total[cls])[:, None]
    gain[at, cls] = 0.0
    return gain


def exchange(matrix: np.ndarray, cls: np.ndarray, width: np.ndarray, context: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The class of each word with the largest exact change of the likelihood; its own if none is above 0."""
    k, words = len(matrix), len(cls)
    best, ends = cls.copy(), np.cumsum(width.astype(np.int64))
    begins = ends - width

    def choose(own: np.ndarray, prior: np.ndarray, after: np.ndarray, itself: np.ndarray) -> np.ndarray:
        gain = gains(matrix, own, prior, after, itself)
        top = gain.argmax(1)
        return np.where(gain[np.arange(len(own)), top] > 1e-9, top, own)

    # words that occur once are alike if their class and both contexts are: each such case is looked at once
    once = np.flatnonzero(width == 2)
    once = once[(number[begins[once]] == 1) & (number[begins[once] + 1] == 1) & (context[begins[once]] < k)]
    case, which = np.unique((cls[once] * k + context[begins[once]]) * k + context[begins[once] + 1] - k, return_inverse=True)
    one = np.eye(k)
    for a in range(0, len(case), 2048):
        c = case[a : a + 2048]
        case[a : a + 2048] = choose(c // (k * k), one[c // k % k], one[c % k], np.zeros(len(c)))
    best[once] = case[which]
    many = np.ones(words, bool)
    many[once] = False
    many = np.flatnonzero(many & (width > 0))
    for a in range(0, len(many), 2048):  # bounded memory
        some = many[a : a + 2048]
        w = width[some].astype(np.int64)
        at = np.repeat(begins[some] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        counts = np.zeros((len(some), 2 * k + 1))
        counts[np.repeat(np.arange(len(some)), w), context[at]] = number[at]
        prior, after, itself, own = counts[:, :k], counts[:, k : 2 * k], counts[:, -1], cls[some]
        prior[np.arange(len(some)), own] -= itself
        after[np.arange(len(some)), own] -= itself
        best[some] = choose(own, prior, after, itself)
    return best


def moved(matrix: np.ndarray, turn: int, share: float):
    """New classes of a range's words. Some rest, others each turn, so that words don't follow one another in circles."""

    def make(own: dict) -> tuple[np.ndarray, None]:
        cls = np.frombuffer(own["class"], np.uint8).astype(np.int64)
        best = exchange(matrix, cls, np.frombuffer(own["width"], np.uint8), np.frombuffer(own["context"], np.uint8).astype(np.int64), unplane(own["number"], "<i8"))
        draw = (np.arange(len(cls)) * 0x9E3779B1 + turn * 0x85EBCA6B) % (1 << 32) / (1 << 32)
        return np.where(draw < share, best, cls), None

    return make


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(matrix: np.ndarray, n: int, v: int, once: int):
    """Scores of a block's documents."""
    of_class = matrix.sum(0)
    unknown = len(matrix)
    transition = np.zeros((unknown + 1, unknown + 1))
    share = of_class / max(of_class.sum(), 1)
    transition[:-1, :-1] = (matrix + SMOOTH * share) / (matrix.sum(1, keepdims=True) + SMOOTH)
    transition[-1, :-1] = share
    miss = min(max(once / max(n, 1), 1 / (n + v + 1)), 0.5)

    def run(blocks: pa.Table, news: pa.Table) -> pa.Table:
        out = []
        for block in blocks.to_pylist():
            lengths, cls, count = unpack(block, news.to_pylist())
            tokens = np.frombuffer(block["tokens"], "<i4")
            known = (count > 0)[tokens]
            c = np.where(known, cls[tokens], unknown)
            begins = np.cumsum(lengths) - lengths
            before = np.empty_like(c)
            before[1:] = c[:-1]
            before[begins] = c[-1]
            x = count[tokens].astype(np.float64)
            in_class = np.append(np.maximum(of_class, 1), 1)[c]
            p = (1 - miss) * (MIX * transition[before, c] * x / in_class + (1 - MIX) * x / max(n, 1))
            ours = np.log10(np.where(known, p, miss))
            base = np.log10((x + 1) / (n + 1 * (v + 1)))
            out += zip(block["doc_ids"], np.frombuffer(block["held"], bool).tolist(), lengths.tolist(), np.add.reduceat(known.astype(np.int64), begins).tolist(), [n] * len(begins), np.add.reduceat(base, begins).tolist(), np.add.reduceat(ours, begins).tolist())
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def add_matrices(rows: pa.Table) -> pa.Table:
    return pa.table({"matrix": pa.array([np.sum(rows.column("matrix").to_pylist(), 0).tolist()], pa.list_(pa.float64()))})


def matrix_of(state: DataFrame, classes: int) -> np.ndarray:
    """CLASSES squared numbers, summed on the executors to at most 8 rows."""
    parts = state.select((F.col("range") % 8).alias("part"), "matrix").groupBy("part").applyInArrow(add_matrices, "matrix array<double>").collect()
    return np.sum([r["matrix"] for r in parts] or [np.zeros(classes * classes)], 0).reshape(classes, classes)


def brown_scores(spark: SparkSession, docs: DataFrame, classes: int = CLASSES, tolerance: float = TOLERANCE, log=None) -> DataFrame:
    """One row of SCORES per document. log, if given, is called with each round's log10 likelihood per training token."""
    if not 2 <= classes <= 127:
        raise ValueError("class and context numbers are bytes: classes must be from 2 to 127")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make_blocks, BLOCKS)
    with small_batches(spark, ROWS_AT_ONCE), bucketed(spark, made, ranges, "block", "brown_blocks", "snappy") as blocks:
        return scores_of(spark, blocks, ranges, classes, tolerance, log)


def scores_of(spark: SparkSession, blocks: DataFrame, ranges: int, classes: int, tolerance: float, log) -> DataFrame:
    """The scores of the documents in these blocks, written."""
    fields = blocks.select("block", "lengths", "held", "tokens")
    words = blocks.select("block", "words", "counts").mapInArrow(to_ranges(ranges), ROWS)
    vocabulary = stage(spark, streamed(words, ranges, Vocabulary), "brown-words")
    places = stage(spark, streamed(words.unionByName(vocabulary), ranges, Places), "brown-places")
    # counts are binary there; their sums and the most frequent words come from small rows
    facts = stage(spark, vocabulary.mapInArrow(word_facts(classes), "tokens bigint, distinct bigint, once bigint, top array<struct<word:bigint,count:bigint>>"), "brown-facts")
    n, v, once = facts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("once"), F.lit(0))).first()
    top = facts.select(F.explode("top").alias("t")).orderBy(F.desc("t.count"), "t.word").limit(classes - 1).collect()
    top = {r["t"]["word"] % (1 << 64): k for k, r in enumerate(top)}

    def send(own: DataFrame, make) -> DataFrame:
        return stage(spark, streamed(own.unionByName(places), ranges, lambda k: Sender(k, make)), "brown-classes")

    def count(news: DataFrame) -> DataFrame:
        sent = fields.groupBy("block").cogroup(news.filter(F.col("kind") == PLACE).groupBy("block")).applyInArrow(contexts(classes), ROWS)
        own = news.filter(F.col("kind") == OWN)
        return stage(spark, streamed(sent.unionByName(places).unionByName(own), ranges, lambda k: Gather(k, classes)), "brown-contexts")

    news, kept, share, turn = send(vocabulary, first_classes(top, classes)), None, MOVING, 0
    while True:
        state = count(news)
        matrix = matrix_of(state, classes)
        value = likelihood(matrix) / max(n, 1) / np.log(10)
        if log:
            log(value)
        gain = value - kept[0] if kept else tolerance
        if kept and gain <= 0:  # too many have moved at once: back, and on from there with fewer
            share /= 2
            unstage(spark, state)
            unstage(spark, news)
        else:
            for x in kept[2:] if kept else ():
                unstage(spark, x)
            kept = value, matrix, news, state
        if 0 < gain < tolerance or share < FEWEST_MOVING or not n:
            break
        turn += 1
        news = send(kept[3], moved(kept[1], turn, share))
    _, matrix, news, state = kept
    # classes and counts go to the blocks for scoring
    known = news.filter(F.col("kind") == OWN).select("range", "class").join(vocabulary.drop("class"), "range").select(*COLUMNS)
    final = streamed(known.unionByName(places), ranges, lambda k: Sender(k, lambda r: (np.frombuffer(r["class"], np.uint8), unplane(r["count"], "<i8")), counts=True))
    out = blocks.select("block", "doc_ids", "lengths", "held", "tokens").groupBy("block").cogroup(final.filter(F.col("kind") == PLACE).groupBy("block")).applyInArrow(score(matrix, n, v, once), SCORES)
    out = stage(spark, out, "brown-scores")
    for x in (news, state, vocabulary, places, facts):
        unstage(spark, x)
    return out


def word_facts(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.select(["at", "count"]).to_pylist():
                words, count = np.frombuffer(r["at"], np.int64), unplane(r["count"], "<i8")
                top = np.argsort(-count, kind="stable")[:classes]
                rows.append((int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), [{"word": int(words[i]), "count": int(count[i])} for i in top if count[i]]))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("word", pa.int64()), ("count", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names=["tokens", "distinct", "once", "top"])

    return run
