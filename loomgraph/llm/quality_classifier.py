"""Quality classifier (operator 5): ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - z), z = the mean weight of a text's words. The weights are shared by all grades and hashed:
a word adds the weights of its lower-case form, of its shape (which kinds of characters follow one another) and, if it
repeats the word before it, of that. The mean is shrunk towards 0 for texts of few words. The
model is fitted with numpy on at most SAMPLE_ROWS labelled rows (the bound is a parameter; rows in the order of the CRC-32 of
their id), and every whole text is scored where it lies, without a shuffle.

The grades come from the labels: 0 is low quality, 1 good quality but toxic, 2 good quality and clean (a null toxic label counts as
clean). Documents of grade 1 and above are selected; the ordered thresholds give P(grade >= 1) and P(grade >= 2).

Defined results: null counts as empty, which has z = 0; rows whose quality is null are not learned from; of several
labels of a document all count. With no labelled rows every text has the expected grade 0 and is selected. Fitting is
deterministic; rows of equal CRC-32 are taken by id. A tail probability equal to SELECT_TAIL selects. Long texts are hashed and scored whole. Repeated rows score alike; an empty table
gives an empty result. Other columns of docs are not read by classify; keep_selected returns them unchanged, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Memo, crc_mod, slices, texts

SAMPLE_ROWS = 6000
#: At most so many bytes of text are fitted, in whole texts (a text beyond it is left out).
SAMPLE_BYTES = 16 << 20
BITS = 18
EPOCHS = 30
RATE = 0.05
DECAY = 1e-4
#: A document is selected if P(grade >= SELECT_GRADE) reaches SELECT_TAIL.
SELECT_GRADE = 1
SELECT_TAIL = 0.5
#: Labels are learned from rows whose crc32(doc_id) mod FOLDS is not 0; the others measure accuracy.
FOLDS = 5

_shape = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b > 127 else 57 if 48 <= b < 58 else b for b in range(256))
_runs = re.compile(rb"(.)\1+", re.S)


def features(word: bytes) -> tuple[int, int]:
    mask = (1 << BITS) - 1
    return zlib.crc32(word.lower()) & mask, zlib.crc32(b"\0" + _runs.sub(rb"\1", word.translate(_shape))) & mask


#: The feature of a word that equals the word before it, and how many words of weight 0 each text is counted to have besides its own.
REPEAT = zlib.crc32(b"\1repeat") & ((1 << BITS) - 1)
SHRINK = 8


def repeats(words: list[bytes]) -> int:
    return sum(map(eq, words, words[1:]))


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - z[:, None], -60, 60)))

    def expected(self, z: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + self.tails(z) @ steps if len(self.grades) > 1 else np.full(len(z), float(self.grades[0]))


def fit(some: list[bytes], ratings: list[int], epochs: int = EPOCHS) -> OrdinalModel:
    """Adam on the log-likelihood; steps between thresholds stay positive as exponentials."""
    grades = sorted(set(ratings)) or [0]
    weights = np.zeros(1 << BITS, np.float32)
    if len(grades) < 2:
        return OrdinalModel(grades, weights, np.zeros(len(grades) - 1))
    memo = Memo(features)
    rows, columns, values = [], [], []
    for i, text in enumerate(some):
        words = text.split()
        found = np.array([memo[w] for w in words], np.int64).ravel()
        ids, count = np.unique(np.append(found, np.full(repeats(words), REPEAT)), return_counts=True)
        rows.append(np.full(len(ids), i))
        columns.append(ids)
        values.append(count / (len(words) + SHRINK))
    n = len(some)
    used, column = np.unique(np.concatenate(columns), return_inverse=True)
    row, value = np.concatenate(rows), np.concatenate(values)
    # a feature of a single text says nothing about others
    often = np.bincount(column, minlength=len(used)) > 1
    keep = often[column]
    row, column, value = row[keep], column[keep], value[keep] * 10
    y = np.searchsorted(grades, ratings)
    tail_rate = np.clip([(y >= k).mean() for k in range(1, len(grades))], 1e-3, 1 - 1e-3)
    theta = -np.log(tail_rate / (1 - tail_rate))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    w = np.zeros(len(used))
    moments = [np.zeros(len(used) + len(free)) for _ in range(2)]
    for t in range(1, epochs * 10 + 1):
        theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        z = np.bincount(row, w[column] * value, n)
        cdf = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(z[:, None] - theta, -60, 60))), np.ones((n, 1))], 1)
        high, low = cdf[np.arange(n), y + 1], cdf[np.arange(n), y]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_w = np.bincount(column, (d_high - d_low)[row] * value, len(used)) / n + DECAY * w
        g_theta = np.array([(d_low[y == k + 1].sum() - d_high[y == k].sum()) / n for k in range(len(theta))])
        after = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, after[:1], after[1:] * np.exp(free[1:])])
        for m, x, b in ((moments[0], g, 0.9), (moments[1], g * g, 0.99)):
            m *= b
            m += (1 - b) * x
        step = RATE * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-8)
        w -= step[: len(used)]
        free -= step[len(used) :]
    weights[used] = w * 10
    return OrdinalModel(grades, weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """Labelled texts of the learning folds, to the driver: at most so many rows and so many bytes, in the order of the CRC-32 of the id."""
    marks = labels.filter(label.isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", FOLDS) != 0))
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = marks.select("doc_id", label.cast("int").alias("y")).orderBy(order, "doc_id", "y").limit(rows)
    # picked has at most that many rows of two numbers, so it may be sent to every task instead of shuffling the texts
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    fits = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(order, "doc_id", "y", "text")) <= most_bytes
    found = found.orderBy(order, "doc_id", "y", "text").limit(rows).select("*", fits.alias("fits")).filter("fits").select("text", "y").toArrow()
    return [x or b"" for x in found.column("text").cast(pa.binary()).to_pylist()], found.column("y").to_pylist()


def grade() -> Column:
    """0 to 2, from the labels."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality").isNotNull(), F.when(F.coalesce("toxic", F.lit(0)) == 0, 2).otherwise(1))


def scorer(model: OrdinalModel) -> Callable[[list[bytes]], np.ndarray]:
    def weight(word: bytes) -> float:
        a, b = features(word)
        return float(model.weights[a] + model.weights[b])

    memo, again = Memo(weight), float(model.weights[REPEAT])

    def z(some: list[bytes]) -> np.ndarray:
        memo.trim()
        get = memo.__getitem__
        return np.array([(sum(map(get, words)) + again * repeats(words)) / (len(words) + SHRINK) for words in map(bytes.split, some)])

    return z


def select_tail(model: OrdinalModel, z: np.ndarray) -> np.ndarray:
    """P(grade >= SELECT_GRADE); 1 where the model knows no higher and no lower grade."""
    k = int(np.searchsorted(model.grades, SELECT_GRADE))
    return np.ones(len(z)) if k == 0 or len(model.grades) < 2 else np.zeros(len(z)) if k >= len(model.grades) else model.tails(z)[:, k - 1]


SCHEMA = "doc_id bigint, expected_grade double, tail_probability double, selected boolean"


def classify(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_grade, tail_probability, selected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in slices(batches):
            z = score(texts(batch))
            tail = select_tail(model, z)
            ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.expected(z)), pa.array(tail), pa.array(tail >= SELECT_TAIL)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_selected(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs, all columns, that the model selects; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in slices(batches):
            yield batch.filter(pa.array(select_tail(model, score(texts(batch))) >= SELECT_TAIL))

    return docs.mapInArrow(run, docs.schema)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> OrdinalModel:
    return fit(*sample(docs, labels, grade(), rows))
