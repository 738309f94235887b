"""Edit-aware token counts (operator 9).

Each document keeps a segment tree whose leaves are its pre-tokens: where each begins and ends in the text's bytes, and how many tokens it has;
an inner node is the sum of its children. build_trees makes the trees once, as a table; edit_trees applies edits to kept trees and gives
trees that can be kept and edited again. An edit touches the leaves that it overlaps or meets; its region is widened by boundary context on both sides: to
white space, or to the first boundary, at least REACH bytes away, that no text beyond it can move (hard()). Only regions are encoded again: their
sum goes into the first of their leaves, the others become 0, and the sums above change in logarithmic time. Kept trees hold their leaves; the sums
above are added up when a tree is read, without encoding anything.

A leaf is a single pre-token, but for letters that Unicode normalisation joins: a leaf begins where both the text and its normalised form
can be cut.

Defined results: null counts as empty; a text without tokens has a tree without leaves. Edits are byte spans [start, end) of
the original text, at boundaries of characters, with a replacement; they are applied as if at once; overlapping ones are refused; insertions at one place keep the order in
which they are given. A long text is one tree, whole. Repeated rows have trees of their own. An empty table gives an empty result. Other columns are not read, so their names
can't clash.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.bpe import ASCII_PRE_TOKEN, MOST_CACHED, PRE_TOKEN, Bpe, bpe, uncollected
from loomgraph.llm.common import SPACE_BYTES, slices, stage, texts

Edit = tuple[int, int, bytes]
#: No special token is longer than this many bytes.
REACH = 16
#: What the built-in edits mask: mail addresses and long numbers. A local part is tried from its begin, and from the end of the address before it,
#: so long words take linear time.
MASKED = re.compile(rb"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9.-]+|[0-9]{4,}")
NEXT = re.compile(rb"[A-Za-z0-9._+-]++@[A-Za-z0-9.-]+")
NUMBER = re.compile(rb"[0-9]{4,}")
MASK = b"<masked>"
_is_space = np.zeros(256, bool)
_is_space[[*SPACE_BYTES]] = True


class CountTree:
    """Sums of token counts over the leaves of one text."""

    def __init__(self, counts: np.ndarray | list[int]):
        self.leaves = 1 << max(0, len(counts) - 1).bit_length()
        self.sums = np.zeros(2 * self.leaves, np.int64)
        self.sums[self.leaves : self.leaves + len(counts)] = counts
        a = self.leaves
        while a > 1:
            self.sums[a // 2 : a] = self.sums[a : 2 * a].reshape(-1, 2).sum(1)
            a //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def put(self, leaf: int, count: int) -> None:
        at = leaf + self.leaves
        change = count - int(self.sums[at])
        while at and change:
            self.sums[at] += change
            at >>= 1


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pieces between white space."""
    inside = np.concatenate([[False], ~_is_space[np.frombuffer(text, np.uint8)], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def starts_afresh(c: str) -> bool:
    """Whether normalisation never joins this character with what is before it."""
    return c.isascii() or (unicodedata.category(c)[0] in "LNPSZ" and not unicodedata.combining(c) and not "ᅠ" <= c <= "ᇿ")


def atoms(text: str) -> list[str]:
    """The text, cut before the characters that start afresh."""
    cuts = [0, *(i for i, c in enumerate(text) if i and starts_afresh(c)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def cut_plain(text: str) -> list[tuple[int, list[str]]]:
    """(bytes, pre-tokens) of the leaves of a text without special tokens."""
    if text.isascii():
        return [(len(x), [x]) for x in ASCII_PRE_TOKEN.findall(text.lower())]
    composed = unicodedata.is_normalized("NFC", text)
    if composed:
        low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        if len(low) == len(text):  # letter by letter the same places
            begins = [m.start() for m in PRE_TOKEN.finditer(low)]
            if len(begins) < 2:
                return [(len(text.encode()), PRE_TOKEN.findall(low))]
            cuts = [0, *begins[1:], len(low)]
            return [(len(text[a:b].encode()), [w]) for a, b, w in zip(cuts, cuts[1:], PRE_TOKEN.findall(low))]
    parts = [*text] if composed else atoms(text)
    norm = ["".join(map(str.lower, unicodedata.normalize("NFC", x))) for x in parts]
    at, where, size = 0, {}, 0  # place in the normalised text -> bytes of the text before it
    for x, y in zip(parts, norm):
        where[at] = size
        at, size = at + len(y), size + len(x.encode())
    leaves: list[list] = []
    for m in PRE_TOKEN.finditer("".join(norm)):
        if m.start() in where or not leaves:
            leaves.append([where.get(m.start(), 0) if leaves else 0, []])
        leaves[-1][1].append(m.group())
    ends = [*(x[0] for x in leaves[1:]), size]
    return [(end - begin, words) for (begin, words), end in zip(leaves, ends)] or [(size, [])]


class LeafCoder:
    """The leaves of white-space separated pieces, memoised in a bounded cache."""

    def __init__(self, coder: Bpe):
        self.coder, self.known = coder, {}

    def know(self, cut: list[list[bytes]]) -> None:
        if len(self.known) > MOST_CACHED:
            self.known.clear()
        missing = set().union(*cut).difference(self.known)
        if not missing:
            return
        coder, whole, found = self.coder, {}, {}  # pieces that are one pre-token, and the others
        if len(coder.words) > MOST_CACHED:
            coder.words.clear()
        for raw in missing:
            if raw.isalpha():  # ASCII letters only
                whole[raw] = raw.lower().decode()
                continue
            piece = raw.decode()
            if b"<|" in raw:
                found[raw] = [y for x in coder.at_special.split(piece) if x for y in ([(len(x), [x])] if x in coder.special else cut_plain(x))]
                continue
            leaves = cut_plain(piece)
            if len(leaves) == 1 and len(leaves[0][1]) == 1:
                whole[raw] = leaves[0][1][0]
            else:
                found[raw] = leaves
        words = set(whole.values())
        for leaves in found.values():
            for _, own in leaves:
                words.update(own)
        if unknown := words.difference(coder.words, coder.special):
            coder.merge([*unknown])
        size = {x: 1 if x in coder.special else len(coder.words[x]) // 4 for x in words}
        pair, many = struct.Struct("<2I").pack, size.__getitem__
        self.known.update((raw, pair(len(raw), size[word])) for raw, word in whole.items())
        for raw, leaves in found.items():
            self.known[raw] = b"".join([pair(n, size[own[0]] if len(own) == 1 else sum(map(many, own))) for n, own in leaves])

    def leaves(self, some: list[bytes]) -> list[np.ndarray]:
        """Per text: begins, ends and counts of its leaves, as rows of one array."""
        cut = [x.split() for x in some]
        self.know(cut)
        get, out = self.known.__getitem__, []
        for text, pieces in zip(some, cut):
            found = [*map(get, pieces)]
            size, count = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2).T.astype(np.int64)
            many = np.fromiter(map(len, found), np.int64, len(found)) // 8
            first = np.cumsum(many) - many
            before = np.cumsum(size) - size
            begin = before + np.repeat(spans(text)[0] - before[first], many)
            out.append(np.stack([begin, begin + size, count]))
        return out


def keep(leaves: np.ndarray) -> bytes:
    """Gaps before leaves, their lengths and counts, each in the least width that holds all of them."""
    begin, end, count = leaves
    parts = [begin - np.append(0, end[:-1])[: len(begin)], end - begin, count]
    widths = [next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w) for x in parts]
    return bytes(widths) + b"".join(x.astype(f"<u{w}").tobytes() for x, w in zip(parts, widths))


def kept(raw: bytes) -> np.ndarray:
    widths, at, parts = raw[:3], 3, []
    n = (len(raw) - 3) // sum(widths)
    for w in widths:
        parts.append(np.frombuffer(raw, f"<u{w}", n, at).astype(np.int64))
        at += n * w
    gap, size, count = parts
    end = np.cumsum(gap + size)
    return np.stack([end - size, end, count])


def kind(c: str) -> str:
    return unicodedata.category(c)[0] if c not in "\x1c\x1d\x1e\x1f" else "P"


def hard(text: bytes, at: int) -> bool:
    """Whether pre-tokens break at this leaf's boundary, whatever stands further away than one character on either side."""
    if not 0 < at < len(text) or _is_space[text[at - 1]] or _is_space[text[at]]:
        return True
    a = text[max(at - 4, 0) : at].decode(errors="ignore")[-1:]
    b = text[at : at + 4].decode(errors="ignore")[:1]
    if not a or not b or not starts_afresh(b) or kind(a) in "MC" or kind(b) in "MC":
        return False
    x, y = (k if (k := kind(c)) in "LN" else "other" for c in (a, b))
    return (x != y and a != "'") or x == y == "N"


def apply_edits(coder: LeafCoder, text: bytes, leaves: np.ndarray, edits: list[Edit]) -> tuple[bytes, np.ndarray, int, int]:
    """The new text and leaves, the new total by the segment tree, and the number of bytes encoded again."""
    tree = CountTree(leaves[2])
    if not edits:
        return text, leaves, tree.total, 0
    edits = sorted(edits, key=lambda e: e[:2])
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:])):
        raise ValueError("edits overlap")
    begins, ends = leaves[0], leaves[1]
    groups: list[list] = []  # first leaf, last leaf, low, high, edits
    for e in edits:
        i, j = int(np.searchsorted(ends, e[0], "left")), int(np.searchsorted(begins, e[1], "right")) - 1
        low, high = e[0], e[1]
        if i <= j:
            while not (begins[i] == 0 or _is_space[text[begins[i] - 1]] or (begins[i] <= e[0] - REACH and hard(text, int(begins[i])))):
                i -= 1
            while not (ends[j] == len(text) or _is_space[text[ends[j]]] or (ends[j] >= e[1] + REACH and hard(text, int(ends[j])))):
                j += 1
            low, high = min(int(begins[i]), low), max(int(ends[j]), high)
        if groups and (i <= groups[-1][1] or low <= groups[-1][3]):
            g = groups[-1]
            g[0], g[1], g[3] = min(g[0], i), max(g[1], j), max(g[3], high)
            g[4].append(e)
        else:
            groups.append([i, j, low, high, [e]])
    parts, at, fresh = [], 0, []
    for _, _, low, high, some in groups:
        new, k = [], low
        for a, b, x in some:
            new += [text[k:a], x]
            k = b
        fresh.append(b"".join([*new, text[k:high]]))
        parts += [text[at:low], fresh[-1]]
        at = high
    out, at, shift = [], 0, 0
    done = [*zip(groups, fresh, coder.leaves(fresh))]
    for (i, j, *_), _, own in sorted(done, key=lambda x: x[0][0] > x[0][1]):
        total = int(own[2].sum())
        if i <= j:
            tree.put(i, total)
            for leaf in range(i + 1, j + 1):
                tree.put(leaf, 0)
        else:  # between two leaves: the leaf before it, or the first, takes the sum as well
            leaf = max(i - 1, 0)
            tree.put(leaf, int(tree.sums[tree.leaves + leaf]) + total)
    for (i, j, low, high, _), part, own in done:
        moved = np.array([[shift], [shift], [0]])
        out += [leaves[:, at:i] + moved, own + np.array([[low + shift], [low + shift], [0]])]
        at, shift = max(j + 1, i), shift + len(part) - (high - low)
    out.append(leaves[:, at:] + np.array([[shift], [shift], [0]]))
    parts.append(text[groups[-1][3] :])
    return b"".join(parts), np.concatenate(out, 1), tree.total, sum(map(len, fresh))


def masked(line: bytes) -> Iterator[tuple[int, int]]:
    """Spans of all mail addresses and long numbers, from left to right."""
    if b"@" not in line:
        yield from (m.span() for m in NUMBER.finditer(line))
        return
    m = MASKED.search(line)
    while m:
        yield m.span()
        m = (line.find(b"@", *m.span()) >= 0 and NEXT.match(line, m.end())) or MASKED.search(line, m.end())


def cleaning_edits(text: bytes) -> list[Edit]:
    """Mask mail addresses and long numbers, and take out lines with a word that repeat an earlier line."""
    seen, edits, at = set(), [], 0
    for line in text.split(b"\n"):
        if line.strip(SPACE_BYTES) and line in seen:
            edits.append((max(at - 1, 0), at + len(line), b""))
        else:
            seen.add(line)
            edits += [(at + a, at + b, MASK) for a, b in masked(line)]
        at += len(line) + 1
    return edits


TREES = "doc_id bigint, text string, tree binary, n_tokens bigint"
COUNTS = "doc_id bigint, n_tokens bigint, n_edits int, n_tokens_edited bigint, text_bytes bigint, bytes_encoded_again bigint"


def named(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def build_trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of TREES: each document's text and its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = LeafCoder(bpe(vocabulary))
        for batch in slices(batches):
            with uncollected():
                trees = coder.leaves(texts(batch))
                columns = [pa.array(map(keep, trees), pa.binary()), pa.array([int(x[2].sum()) for x in trees], pa.int64())]
            yield named(TREES, [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), *columns])

    return docs.select("doc_id", "text").mapInArrow(run, TREES)


def edit_trees(trees: DataFrame, vocabulary: str, find_edits: Callable[[bytes], list[Edit]] | str, counts_only: bool = False) -> DataFrame:
    """Kept trees after edits: rows of TREES with the new texts and trees, or of COUNTS if counts_only. find_edits gives a text's edits, or is the
    name of a column array<struct<start, end, replacement>> that holds them."""
    column = find_edits if isinstance(find_edits, str) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = LeafCoder(bpe(vocabulary))
        for batch in slices(batches):
            some = texts(batch)
            if column:
                edits = [[(e["start"], e["end"], (e["replacement"] or "").encode()) for e in x or []] for x in batch.column(4).to_pylist()]
            else:
                edits = [*map(find_edits, some)]
            with uncollected():
                done = [apply_edits(coder, text, kept(tree), e) for text, tree, e in zip(some, batch.column(2).to_pylist(), edits)]
            ids, total = batch.column(0), pa.array([x[2] for x in done], pa.int64())
            if counts_only:
                yield named(COUNTS, [ids, batch.column(3), pa.array([*map(len, edits)], pa.int32()), total, pa.array([*map(len, some)], pa.int64()), pa.array([x[3] for x in done], pa.int64())])
            else:
                yield named(TREES, [ids, pa.array([x[0] for x in done], pa.binary()).cast(pa.string()), pa.array([keep(x[1]) for x in done], pa.binary()), total])

    return trees.select("doc_id", "text", "tree", "n_tokens", *([column] if column else [])).mapInArrow(run, COUNTS if counts_only else TREES)


def count_edited(spark: SparkSession, docs: DataFrame, vocabulary: str, find_edits: Callable[[bytes], list[Edit]] = cleaning_edits) -> DataFrame:
    """Token counts of each document before and after its edits (rows of COUNTS). The trees are written first and the edits applied to the kept ones."""
    trees = stage(spark, build_trees(docs, vocabulary), "token-trees", "zstd")
    return edit_trees(trees, vocabulary, find_edits, counts_only=True)
