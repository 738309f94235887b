"""BPE encoding and decoding (operator 4) with segment trees over adjacent pair ranks.

A leaf of a word's tree holds the rank of the pair of a symbol and the next one, and its position; an inner node the
minimum of its children. The root is the leftmost pair of lowest rank. A merge changes three leaves, and each change
goes up the tree in logarithmic time, until the root holds no mergeable pair. Short words of one batch are merged
together, as rows of one array of trees; long ones have a tree of their own, so a run of 10^5 characters stays n log n.

White space always separates pre-tokens, so a text's ids are those of its white-space separated pieces in order,
and pieces are memoised in a bounded cache.

Defined results: a null or empty text, or one of white space, has no ids and decodes to the empty string. Strings of
special tokens in a text become their ids, as the library does. Of pairs of equal rank the leftmost merges first. Repeated rows are
encoded alike, a row each; an empty table gives an empty result. Other columns pass through encode_documents unchanged, but for those
named ids and decoded, which are replaced; digest_documents does not read them. The vocabulary's path is a parameter.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.common import slices, texts

#: The pre-tokenizer's pattern in the vocabulary file, with its white space spelled out.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
END = "</w>"
NONE = np.int64(1 << 40)
#: Words with more symbols than this have a tree of their own.
TOGETHER = 64
MOST_CACHED = 300_000


def byte_letters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max(max(vocab.values()), *special.values()) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        letters = byte_letters()
        self.first = np.array([vocab[x] for x in letters] + [vocab[x + END] for x in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array([a << 20 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1 << 62))
        found = np.array([*self.pairs.values()], np.int64)[order]
        self.ranks, self.merged = np.append(found[:, 0], NONE), found[:, 1]
        self.by_rank = np.empty(len(found), np.int64)
        self.by_rank[found[:, 0]] = found[:, 1]
        self.words: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; NONE for those that don't merge. Symbol -1 pairs with nothing."""
        key = (a << 20) | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_together(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of up to TOGETHER bytes; row m of every array is word m."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        leaves = 1 << max(1, int(length.max() - 1).bit_length())
        m, n = len(words), leaves + 2
        sym = np.full((m, n), -1, np.int64)  # column i + 1 is byte i; the columns at both ends stay empty
        inside = np.arange(leaves) < length[:, None]
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        flat[np.cumsum(length) - 1] += 256  # the last byte of a word carries the end mark
        sym[:, 1:-1][inside] = self.first[flat]
        pos = np.arange(leaves, dtype=np.int64)
        tree = np.full((m, 2 * leaves), NONE << 8, np.int64)
        tree[:, leaves:] = self.rank(sym[:, 1:-1], sym[:, 2:]) << 8 | pos
        for level in range(leaves.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        nxt = np.tile(np.arange(1, n + 1, dtype=np.int64), (m, 1))
        prv = np.tile(np.arange(-1, n - 1, dtype=np.int64), (m, 1))
        nxt[np.arange(m), length] = n - 1
        T, S, X, P = tree.ravel(), sym.ravel(), nxt.ravel(), prv.ravel()
        rows = np.arange(m)
        while True:
            root = T[rows * 2 * leaves + 1]
            go = root < NONE << 8
            rows, root = rows[go], root[go]
            if not len(rows):
                break
            base, top = rows * n, rows * 2 * leaves
            i = (root & 255) + 1
            j = X[base + i]
            k = X[base + j]
            S[base + i] = new = self.by_rank[root >> 8]
            S[base + j] = -1
            X[base + i] = k
            P[base + k] = i
            h = P[base + i]
            # the pair that begins at j is gone; those that begin at i and before it are new
            T[top + leaves + j - 1] = NONE << 8
            T[top + leaves + i - 1] = self.rank(new, S[base + k]) << 8 | (i - 1)
            before = np.where(h > 0, h, i)
            left = np.where(h > 0, self.rank(S[base + h], new) << 8 | (h - 1), T[top + leaves + i - 1])
            T[top + leaves + before - 1] = left
            for p in (j, i, before):
                p = (p - 1 + leaves) >> 1
                while True:
                    at = top + p
                    T[at] = np.minimum(T[top + 2 * p], T[top + 2 * p + 1])
                    if p[0] <= 1:
                        break
                    p >>= 1
        alive = sym >= 0
        ids = sym[alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def merge_alone(self, word: bytes) -> bytes:
        """Ids of one long word, with plain lists."""
        flat = [*word]
        flat[-1] += 256
        sym = self.first[flat].tolist() + [-1]
        n, leaves = len(flat), 1 << (len(flat) - 1).bit_length()
        nxt, prv = list(range(1, n + 2)), list(range(-1, n))
        none = (1 << 40, 0)
        key = lambda i: (self.pairs[p][0], i) if (p := (sym[i], sym[nxt[i]])) in self.pairs else none
        tree = [none] * leaves + [key(i) for i in range(n)] + [none] * (leaves - n)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            i += leaves
            tree[i] = value
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        while tree[1] is not none and tree[1] < none:
            rank, i = tree[1]
            j = nxt[i]
            sym[i], sym[j] = int(self.by_rank[rank]), -1
            nxt[i] = nxt[j]
            prv[nxt[j]] = i
            put(j, none)
            put(i, key(i))
            if prv[i] >= 0:
                put(prv[i], key(prv[i]))
        return np.array([x for x in sym if x >= 0], "<u4").tobytes()

    def merge(self, words: list[str]) -> None:
        """Put the ids of pre-tokens into self.words."""
        raw = [w.encode() for w in words]
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(raw):
            by_size.setdefault(min(len(w) - 1, TOGETHER).bit_length(), []).append(k)
        for group in by_size.values():
            together = [k for k in group if len(raw[k]) <= TOGETHER]
            for begin in range(0, len(together), 20_000):
                part = together[begin : begin + 20_000]
                self.words.update(zip((words[k] for k in part), self.merge_together([raw[k] for k in part])))
            self.words.update((words[k], self.merge_alone(raw[k])) for k in group if len(raw[k]) > TOGETHER)

    def pre_tokens(self, piece: str) -> list[str]:
        if piece.isascii():
            return ASCII_PRE_TOKEN.findall(piece.lower())
        piece = unicodedata.normalize("NFC", piece)
        # letter by letter: the library knows no final sigma
        return PRE_TOKEN.findall("".join(map(str.lower, piece)) if "Σ" in piece else piece.lower())

    def learn(self, pieces: set[bytes]) -> None:
        """Put the ids of white-space separated pieces into self.pieces."""
        if len(self.words) > MOST_CACHED:
            self.words.clear()
        special, known, cut = self.special, self.words, {}
        for raw in pieces:
            piece = raw.decode()
            if b"<|" in raw:
                cut[raw] = [y for x in self.at_special.split(piece) if x for y in ([x] if x in special else self.pre_tokens(x))]
            elif raw.isalpha():  # ASCII letters only: one pre-token
                cut[raw] = (piece.lower(),)
            else:
                cut[raw] = self.pre_tokens(piece)
        if unknown := set().union(*cut.values()).difference(known, special):
            self.merge([*unknown])
        for raw, c in cut.items():
            if len(c) == 1 and b"<|" not in raw:
                self.pieces[raw] = known[c[0]]
            else:
                self.pieces[raw] = b"".join([special.get(x) or known[x] if x[:2] == "<|" else known[x] for x in c])

    def know(self, cut: list[list[bytes]]) -> None:
        """See that self.pieces has all pieces of these texts."""
        if len(self.pieces) > MOST_CACHED:
            self.pieces.clear()
        if missing := set().union(*cut).difference(self.pieces):  # not "- keys()", which walks the whole cache
            self.learn(missing)

    def encode(self, some: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [x.split() for x in some]
        self.know(cut)
        get = self.pieces.__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def decode(self, ids: bytes) -> str:
        """As the library without a decoder: the tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def bpe(path: str) -> Bpe:
    """One per Python worker."""
    return Bpe(path)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """The garbage collector rests while a task fills its caches: they hold many small objects without cycles, which it would only walk again and again."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


def encode_documents(docs: DataFrame, vocabulary: str, decoded: bool = True) -> DataFrame:
    """All columns of docs, and ids (array<int>), and decoded unless it is not asked for. Columns of docs with these names, in any case, are replaced."""
    keep = docs.select(*[f"`{x}`" for x in docs.columns if x.lower() not in ("ids", "decoded")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in slices(batches):
            with uncollected():
                ids = coder.encode(texts(batch))
                more = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))]
                if decoded:
                    more.append(pa.array([coder.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "ids", "decoded"][: batch.num_columns + len(more)])

    kinds = T.StructType([*keep.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return keep.mapInArrow(run, T.StructType([*kinds.fields, T.StructField("decoded", T.StringType())]) if decoded else kinds)


DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digest_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and digests of the ids and of the text decoded from them, without carrying either through the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in slices(batches):
            with uncollected():
                ids = coder.encode(texts(batch))
                sha = [hashlib.sha256(x).hexdigest() for x in ids]
                back = [hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids]
            doc = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([doc, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=[x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST_SCHEMA)
