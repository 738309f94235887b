"""Periodic runs of words (operator 11) by Baier grouping.

A run is a stretch of words with smallest period q that no neighbouring word extends; those of at least max(LEAST, 2 q) words are found.

1. Words become numbers. A run of LEAST words holds two equal GRAM-grams, q words apart, that cover it together, so only stretches covered by GRAM-grams that occur
   twice in them can hold runs. That is exact (equal hashes only widen a stretch), and prose without repeats ends here.
2. The first phase of Baier's suffix sorter runs on each stretch: suffixes are grouped by their first word, groups are taken from the greatest down, and each suffix of a
   group lengthens the context of the nearest suffix before it that lies in a lower group. A suffix's context is then the longest Lyndon word that begins at it, so the phase
   gives the Lyndon array without sorting any further. It is run under the order of the words and under its reverse.
3. Every run has a Lyndon root under one of both orders. Each Lyndon word (i, p) is extended by longest common extensions of i and i + p to both sides,
   by bisection on prefix hashes; the extents are then compared word by word, so hashes decide nothing.
4. Words behind the first period of a run are dropped from the collapsed text.

A document is one row and is worked on alone, in time n log n; there is no shuffle. Executors that are lost cost their tasks only.

Defined results: null counts as empty; a text without words has no runs and the empty text as collapsed text. Repeated rows are judged alike. Runs that overlap are
all given, by start, then period. Very long texts are handled whole. An empty table gives an empty result. Other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, texts
from loomgraph.llm.substring_dedup import ranges, rolled, stir

LEAST = 12
GRAM = LEAST // 2
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
PLANTED = "doc_id bigint, text string"


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place, ranks being small integers from 0 on: the first phase of Baier's sorter.

    Places of groups that are done leave a doubly linked list, lowest place first, so what is left of a place when it leaves is the nearest one before it in a
    lower group. Its context grows by that of the group that is done. Places that gain equally much leave their group for a new one right above it."""
    n = len(ranks)
    groups: list[list[int]] = [[] for _ in range(max(ranks, default=-1) + 1)]
    for i, r in enumerate(ranks):
        groups[r].append(i)
    of = ranks[:]
    above, below = list(range(1, len(groups) + 1)), list(range(-1, len(groups) - 1))
    left, right = list(range(-1, n)), list(range(1, n + 2))  # the last entries stand for both ends
    length = [1] * n
    g = len(groups) - 1
    while g >= 0:
        members = [i for i in groups[g] if of[i] == g]
        if members:
            gain = length[members[0]]
            gained: list[list[int]] = []
            last = -1
            for i in members:
                j, k = left[i], right[i]
                right[j], left[k] = k, j
                if j < 0:
                    continue
                if j == last:
                    gained[-1][1] += 1
                else:
                    gained.append([j, 1])
                    last = j
            if len(gained) == 1:
                j, times = gained[0]
                length[j] += times * gain
                moved = {(-times, of[j]): [j]}
                order = moved
            else:
                moved = {}
                for j, times in gained:
                    length[j] += times * gain
                    moved.setdefault((-times, of[j]), []).append(j)
                order = sorted(moved) if len(moved) > 1 else moved
            for key in order:  # those that gain most lie highest
                parent, new = key[1], len(groups)
                for j in moved[key]:
                    of[j] = new
                groups.append(moved[key])
                up = above[parent]
                above.append(up)
                below.append(parent)
                above[parent] = new
                if up < new:
                    below[up] = new
            groups[g] = members[:0]
        g = below[g]
    return length


def stretches(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, begin, end) of what can hold runs, in several texts laid end to end."""
    n = len(words)
    doc = np.repeat(np.arange(len(begins)), ends - begins)
    if n < LEAST:
        return []
    salt = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    gram = stir(rolled(stir(words.astype(np.uint64)), GRAM) + salt)
    inside = np.arange(n) + GRAM <= ends[doc]
    at = np.flatnonzero(inside)
    at = at[np.argsort(gram[at], kind="stable")]
    same = gram[at[1:]] == gram[at[:-1]]
    a, b = at[:-1][same], at[1:][same]  # neighbouring occurrences
    found: list[tuple[int, int, int]] = []
    for last in (False, True):
        cover = np.zeros(n + 1, np.int64)
        for x in (a, b):
            np.add.at(cover, x, 1)
            np.add.at(cover, x + GRAM, -1)
        on = np.cumsum(cover[:-1]) > 0
        edge = np.ones(n, bool)
        edge[1:] = (doc[1:] != doc[:-1]) | ~on[:-1]
        head = np.flatnonzero(on & edge)
        if not len(head):
            return []
        tail = np.ones(n, bool)
        tail[:-1] = (doc[1:] != doc[:-1]) | ~on[1:]
        stop = np.flatnonzero(on & tail) + 1
        if last:
            return [(int(doc[x]), int(x), int(y)) for x, y in zip(head, stop) if y - x >= LEAST]
        number = np.searchsorted(head, np.arange(n), "right")
        # both in one stretch: what is repeated elsewhere only can't be a run's
        near = number[a] == number[b]
        a, b = a[near], b[near]
    return found


def extents(words: np.ndarray, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each i and i + p agree: words to the right from them on, and words to the left of them, by bisection on prefix hashes, then checked word by word."""
    n, mixed = len(words), stir(words.astype(np.uint64))
    out = []
    for way in (1, -1):
        most = (n - i - p) if way == 1 else i
        low, high = np.zeros(len(i), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            a = i if way == 1 else i - mid
            same = ranges(mixed, a, a + mid) == ranges(mixed, a + p, a + p + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out.append(low)
    return out[0], out[1]


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    ids, ranks = np.unique(words, return_inverse=True)
    n, found = len(words), []
    for order in (ranks, len(ids) - 1 - ranks):
        p = np.array(lyndon_array(order.tolist()), np.int64)
        i = np.arange(n)
        keep = i + p < n
        i, p = i[keep], p[keep]
        # a run's root agrees with the words one period on, to the right or to the left
        keep = (words[i] == words[i + p]) | ((i > 0) & (words[i - 1] == words[i + p - 1]))
        i, p = i[keep], p[keep]
        right, left = extents(words, i, p)
        length = left + p + right
        keep = (length >= 2 * p) & (length >= LEAST)
        found.append(np.stack([(i - left)[keep], length[keep], p[keep]], 1))
    every = np.unique(np.concatenate(found), axis=0)
    out = [exact(words, *map(int, r)) for r in every]
    return sorted({r for r in out if r[1] >= max(LEAST, 2 * r[2])}, key=lambda r: (r[0], r[2]))


def exact(words: np.ndarray, start: int, length: int, period: int) -> tuple[int, int, int]:
    """The run itself, whatever the hashes said: its middle is compared, then its ends."""
    differ = np.flatnonzero(words[start : start + length - period] != words[start + period : start + length])
    if len(differ):  # two unequal ranges had one hash: begin again from the longest stretch that agrees
        cuts = np.concatenate([[-1], differ, [length - period]])
        k = int(np.diff(cuts).argmax())
        start, length = start + int(cuts[k]) + 1, int(cuts[k + 1] - cuts[k]) - 1 + period
    return start, length, period


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by spaces."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        some = [x.split() for x in texts(batch)]
        n = np.array([len(w) for w in some], np.int64)
        number: dict[bytes, int] = {}
        flat = np.fromiter((number.setdefault(w, len(number)) for one in some for w in one), np.int64, int(n.sum()))
        begins = np.cumsum(n) - n
        runs: list[list[tuple[int, int, int]]] = [[] for _ in some]
        for doc, a, b in stretches(flat, begins, begins + n):
            runs[doc] += [(s + a - int(begins[doc]), length, period) for s, length, period in runs_of(flat[a:b])]
        columns = [
            batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(n),
            pa.array([[dict(zip(("start", "length", "period"), r)) for r in sorted(one, key=lambda r: (r[0], r[2]))] for one in runs], pa.list_(RUN)),
            pa.array([collapse(w, r) for w, r in zip(some, runs)], pa.binary()).cast(pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start word, length, period; by start, then period), collapsed (the text without what its runs repeat)."""
    return docs.select("doc_id", "text").mapInArrow(find, SCHEMA)


def longest(runs: Column) -> Column:
    """The run with the greatest length, then the least start, then the least period; null without any."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def listed(runs: Column) -> Column:
    """One line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, told by the CRC-32 h of their id, with words repeated from word a = g % n on with period 1 + (n - a) // (3 + g % 8),
    where g = h // 10; the others as they are. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = texts(batch)
            for k, g in enumerate(batch.column(2).to_pylist()):
                words = out[k].split() if g is not None else []
                if n := len(words):
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    cycle = words[a : a + p]
                    out[k] = b" ".join(words[:a] + cycle * ((n - a) // p) + cycle[: (n - a) % p])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return marked.mapInArrow(plant, PLANTED)
