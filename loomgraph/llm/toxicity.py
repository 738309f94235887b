"""Toxicity (operator 1): a convolutional text classifier.

A word's embedding is the sum of the row of its own hash and the mean of the rows of its hashed 4-grams of bytes (with marks at both
ends of the word), so a word that was never seen is placed by its parts. Filters of widths 1 to 3 slide over the words, each filter's maximum
over the whole text is kept, and a logistic layer gives the probability. Everything is learned in numpy from random weights, on a bounded sample
of labelled rows of the learning folds (SAMPLE_ROWS, SAMPLE_BYTES; whole texts): epochs go on until the loss on the sample's
calibration rows, which are not fitted, has not fallen for PATIENCE epochs, and the best epoch's weights are kept. On the same rows a decision
threshold is calibrated for each language; the language is guessed from the text's function words, never read from a column. Scores are stretched
so that a language's threshold is 0.5.

Defined results: null counts as empty, whose score is that of a text without words; without labels of both kinds all score 0.
A score of exactly 0.5 predicts 1. Fitting is deterministic; repeated rows score alike; long texts are convolved in blocks, so memory does not
grow with them; an empty table gives an empty result. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, texts
from loomgraph.llm.quality_classifier import FOLDS, sample

SAMPLE_ROWS = 6000
SAMPLE_BYTES = 8 << 20
BITS = 18
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 16
EPOCHS = 40  # at most
PATIENCE = 4
#: A fall of the loss by less than this counts as none.
FALL = 1e-4
#: An epoch sees at least so many texts, if need be some more than once.
EPOCH_TEXTS = 2048
BATCH = 128
RATE = 0.005
#: Share of words that are blanked while fitting.
DROP = 0.4
#: Every such row of the sample calibrates thresholds and is not fitted.
CALIBRATE = 4
FEWEST_TOXIC = 15
GRAM = 4
PAD = 0  # the index of the word that pads texts; its embedding is zero
BLOCK = 1 << 12
MOST_WORDS = 400_000

#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with they at be this have from or by not he his",
    "fr": "le la les des du et est une qui dans pour sur par au avec ce il elle pas plus sont nous vous ne",
    "de": "der die das und ist nicht ein eine zu den von mit auf sich auch dem des im für wird als an es",
    "es": "el los las y es una por con para del se lo su al como más pero sus este ha no si",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]
_language = {w.encode(): k for k, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}
_edges = b".,;:!?|*$%&#<>\"'()[]{}-"


def buckets(word: bytes) -> list[int]:
    """The row of the word itself, then those of its 4-grams; none for a word of punctuation."""
    w = word.lower().strip(_edges)
    if not w:
        return []
    marked, crc, mask = b"<" + w + b">", zlib.crc32, (1 << BITS) - 1
    return [crc(w) & mask, *(crc(marked[i : i + GRAM], 1) & mask for i in range(max(len(marked) - GRAM, 0) + 1))]


class Words(dict):
    """The number of each word seen so far; what the words are made of is kept as flat arrays."""

    def __init__(self):
        self.rows, self.sizes, self.languages = [], [0], [len(LANGUAGES) - 1]

    def __missing__(self, word: bytes) -> int:
        found = buckets(word)
        self[word] = n = len(self.sizes)
        self.rows += found
        self.sizes.append(len(found))
        self.languages.append(_language.get(word.lower().strip(_edges), len(LANGUAGES) - 1))
        return n


def guess(languages: np.ndarray) -> int:
    """The language with most function words, the first of those in a tie."""
    n = np.bincount(languages, minlength=len(LANGUAGES))[:-1]
    return int(n.argmax()) if n.any() else len(LANGUAGES) - 1


def packed(some: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers, each text followed by padding, and where each text begins; the last entry is the end."""
    gap, parts, begins = np.zeros(max(WIDTHS), np.int32), [], [0]
    for text in some:
        own = text.split()
        parts += [np.fromiter(map(words.__getitem__, own), np.int32, len(own)), gap]
        begins.append(begins[-1] + len(own) + len(gap))
    return np.concatenate([*parts, gap[:0]]), np.array(begins, np.int64)


@dataclass
class Cnn:
    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), 0.5))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.biases, self.out, self.bias]

    def embed(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Embeddings of words; rows: their buckets one after another, sizes: how many each has."""
        out = np.zeros((len(sizes), self.table.shape[1]), self.table.dtype)
        has = np.flatnonzero(sizes)
        if len(has):
            begins = (np.cumsum(sizes) - sizes)[has]
            found = self.table[rows]
            whole = found[begins]
            out[has] = whole + (np.add.reduceat(found, begins, 0) - whole) / np.maximum(sizes[has, None] - 1, 1)
        return out

    def maxima(self, ids: np.ndarray, begins: np.ndarray, embeddings: np.ndarray) -> np.ndarray:
        """Each filter's maximum over each text, block by block."""
        n = len(begins) - 1
        pooled = np.full((n, len(self.out)), -np.inf, self.table.dtype)
        # all widths and shifts in one product; a shift of a filter is added one place further
        whole = np.concatenate([step for f in self.filters for step in f], 1)
        for a in range(0, len(ids), BLOCK):
            b = min(a + BLOCK, len(ids))
            z = embeddings[ids[a : min(b + max(WIDTHS) - 1, len(ids))]] @ whole
            first, last = np.searchsorted(begins, a, "right") - 1, np.searchsorted(begins, b, "left")
            at = np.maximum(begins[first:last], a) - a
            column = 0
            for k, f in enumerate(self.filters):
                y = z[: b - a, column : column + FILTERS]
                for s in range(1, len(f)):
                    more = z[s : b - a + s, column + s * FILTERS : column + (s + 1) * FILTERS]
                    y[: len(more)] += more
                column += len(f) * FILTERS
                part = pooled[first:last, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(part, np.maximum.reduceat(y, at, 0), out=part)
        return pooled

    def probability(self, ids: np.ndarray, begins: np.ndarray, embeddings: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.maxima(ids, begins, embeddings) + np.concatenate(self.biases), 0)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias[0], -30, 30).astype(np.float64)))

    def score(self, p: np.ndarray, languages: np.ndarray) -> np.ndarray:
        t = self.thresholds[languages]
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))


def random_net(kind: type = np.float32) -> Cnn:
    """Small random weights, the same each time."""
    rng = np.random.default_rng(7)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(kind)
    filters = [draw(0.3, w, DIM, FILTERS) for w in WIDTHS]
    return Cnn(draw(0.03, 1 << BITS, DIM), filters, [np.zeros(FILTERS, kind) for _ in WIDTHS], draw(0.3, FILTERS * len(WIDTHS)), np.array([-1.0], kind))


class Sample:
    """Texts as numbers of words, and what those words are made of."""

    def __init__(self, some: list[bytes]):
        words = Words()
        self.ids, self.begins = packed(some, words)
        self.rows, self.sizes = np.array(words.rows, np.int64), np.array(words.sizes, np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        languages = np.array(words.languages)
        self.languages = np.array([guess(languages[self.ids[a:b]]) for a, b in zip(self.begins[:-1], self.begins[1:])], np.int64)

    def part(self, texts_: np.ndarray, drop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: numbers of words among those that occur, begins, and those words' buckets and how many each has."""
        spans = [self.ids[self.begins[i] : self.begins[i + 1]] for i in texts_]
        begins = np.concatenate([[0], np.cumsum([len(x) for x in spans])])
        flat = np.concatenate(spans)
        if drop is not None:
            flat = np.where(drop[: len(flat)], PAD, flat)
        used, ids = np.unique(flat, return_inverse=True)
        sizes = self.sizes[used]
        rows = self.rows[np.repeat(self.at[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        return ids, begins, rows, sizes


def gradients(net: Cnn, ids: np.ndarray, begins: np.ndarray, rows: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
    """The weighted log-loss, its gradients by parameter (of the table only the rows used), and those rows."""
    n, e = len(begins) - 1, net.embed(rows, sizes)
    x, d_word = e[ids], np.zeros_like(e)
    text = np.repeat(np.arange(n), np.diff(begins))
    best, tops = [], []
    for f in net.filters:
        out = x @ f[0]
        for s in range(1, len(f)):
            out[:-s] += x[s:] @ f[s]
        top = np.maximum.reduceat(out, begins[:-1], 0)
        where, which = np.nonzero(out == top[text])
        at = np.empty((n, FILTERS), np.int64)
        at[text[where[::-1]], which[::-1]] = where[::-1]  # the first of equal maxima
        best.append(at)
        tops.append(top)
    pre = np.concatenate(tops, 1) + np.concatenate(net.biases)
    pooled = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias[0], -30, 30)))
    loss = -float((weight * np.where(y == 1, np.log(p + 1e-12), np.log(1 - p + 1e-12))).sum())
    d = ((p - y) * weight).astype(e.dtype)
    d_pre = d[:, None] * net.out * (pre > 0)
    d_filters = []
    for k, f in enumerate(net.filters):
        g, d_f = d_pre[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(f)
        for s in range(len(f)):
            at = best[k] + s
            inside = at < len(ids)
            at = np.minimum(at, len(ids) - 1)
            d_f[s] = np.einsum("tf,tfd->df", g * inside, x[at])
            np.add.at(d_word, ids[at].ravel(), ((g * inside)[:, :, None] * f[s].T[None]).reshape(-1, f.shape[1]))
        d_filters.append(d_f)
    has = sizes > 0
    share = np.repeat(d_word[has] / np.maximum(sizes[has, None] - 1, 1), sizes[has], 0)
    share[(np.cumsum(sizes) - sizes)[has]] = d_word[has]
    used, at = np.unique(rows, return_inverse=True)
    d_table = np.stack([np.bincount(at, share[:, c], len(used)) for c in range(share.shape[1])], 1).astype(e.dtype) if len(rows) else share
    parts = np.split(d_pre.sum(0), len(net.filters))
    return loss, [d_table, *d_filters, *parts, pooled.T @ d, np.array([d.sum()], e.dtype)], used


def balance(y: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Weights of labels y by which both labels count alike among those of the rows `of`."""
    rate = np.clip(y[of].mean(), 0.02, 0.98)
    return np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate))


def fit(some: list[bytes], toxic: list[int], epochs: int = EPOCHS, log=None) -> Cnn | None:
    """None without texts of both kinds. Adam; of the table, only rows whose words are at a maximum move."""
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return None
    data, net, rng = Sample(some), random_net(), np.random.default_rng(11)
    held = np.arange(len(y)) % CALIBRATE == 0 if min(y.sum(), (1 - y).sum()) >= 4 * CALIBRATE else np.zeros(len(y), bool)
    learn, judge = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in net.parameters()]
    weight, judge_weight = balance(y, learn), balance(y, judge)[judge]
    parts = [data.part(some_) for some_ in np.array_split(judge, max(1, len(judge) // 256))]

    def probabilities() -> np.ndarray:
        return np.concatenate([net.probability(ids, begins, net.embed(rows, sizes)) for ids, begins, rows, sizes in parts])

    def judged() -> float:
        p = np.clip(probabilities(), 1e-7, 1 - 1e-7)
        return float((judge_weight * -np.where(y[judge] == 1, np.log(p), np.log(1 - p))).mean())

    least, kept, since, t = judged(), [v.copy() for v in net.parameters()], 0, 0
    for epoch in range(epochs):
        order = np.concatenate([rng.permutation(learn) for _ in range(-(-EPOCH_TEXTS // len(learn)))])
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            t += 1
            drop = rng.random(int((data.begins[batch + 1] - data.begins[batch]).sum()), np.float32) < DROP
            _, grads, used = gradients(net, *data.part(batch, drop), y[batch], weight[batch] / len(batch))
            for k, (v, g, (m, s)) in enumerate(zip(net.parameters(), grads, moments)):
                at = used if k == 0 else slice(None)
                m[at] = 0.9 * m[at] + 0.1 * g
                s[at] = 0.99 * s[at] + 0.01 * g * g
                v[at] -= RATE * (m[at] / (1 - 0.9**t)) / (np.sqrt(s[at] / (1 - 0.99**t)) + 1e-6)
        now = judged()
        if log:
            log(epoch, now)
        if now < least - FALL:
            least, kept, since = now, [v.copy() for v in net.parameters()], 0
        elif (since := since + 1) >= PATIENCE:
            break
    for v, best in zip(net.parameters(), kept):
        v[...] = best
    if held.any():
        p = probabilities()
        whole = threshold(p, y[judge])
        for k in range(len(LANGUAGES)):
            own = data.languages[judge] == k
            net.thresholds[k] = threshold(p[own], y[judge][own]) if y[judge][own].sum() >= FEWEST_TOXIC else whole
    return net


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the range of thresholds with the best F1."""
    steps = np.linspace(0.02, 0.98, 97)
    hit = p[:, None] >= steps
    tp = (hit & (y == 1)[:, None]).sum(0)
    f1 = 2 * tp / np.maximum(hit.sum(0) + y.sum(), 1)
    return float(np.median(steps[f1 >= f1.max() - 1e-9]))


class Scorer:
    """Scores texts in a task; keeps the embeddings of the words seen so far, a bounded number."""

    def __init__(self, net: Cnn):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.words = Words()
        self.known = 1
        self.embeddings, self.languages = np.zeros((1 << 12, self.net.table.shape[1]), self.net.table.dtype), np.full(1 << 12, len(LANGUAGES) - 1, np.int8)

    def __call__(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and guessed languages."""
        if self.known > MOST_WORDS:
            self.forget()
        words = self.words
        ids, begins = packed(some, words)
        a, b = self.known, len(words.sizes)
        while b > len(self.embeddings):
            self.embeddings, self.languages = np.concatenate([self.embeddings] * 2), np.concatenate([self.languages] * 2)
        self.embeddings[a:b] = self.net.embed(np.array(words.rows, np.int64), np.array(words.sizes[a:], np.int64))
        self.languages[a:b] = words.languages[a:]
        words.rows, self.known = [], b
        languages = self.languages[ids]
        return self.net.probability(ids, begins, self.embeddings), np.array([guess(languages[a:b]) for a, b in zip(begins[:-1], begins[1:])], np.int64)


SCHEMA = "doc_id bigint, score double, predicted int, language string, raw_probability double"


def score_documents(docs: DataFrame, net: Cnn | None) -> DataFrame:
    """doc_id, score, predicted (score >= 0.5), guessed language, probability before calibration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in slices(batches, 2 << 20):
            some = texts(batch)
            n = len(some)
            p, languages, score = np.zeros(n), np.full(n, len(LANGUAGES) - 1), np.zeros(n)
            if scorer and n:
                p, languages = scorer(some)
                score = net.score(p, languages)
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array([LANGUAGES[k] for k in languages], pa.string()), pa.array(p, pa.float64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Cnn | None:
    """Learns only from rows whose crc32(doc_id) mod FOLDS is not 0."""
    assert FOLDS == 5
    return fit(*sample(docs, labels, F.col("toxic"), rows, SAMPLE_BYTES))
