"""SimHash near-dedup (operator 3) with pigeonring filtering.

Fingerprints of 64 bits are cut into SEGMENTS segments on a ring. If two differ in at most DISTANCE bits, there is a
segment from which every chain of l consecutive segments has at most l * DISTANCE / SEGMENTS differing bits (the
pigeonring principle, strong form). With 6 segments and distance 2 the budgets of chains of 1 to 5 segments are 0, 0, 1, 1, 1:
the first two segments agree, and the next three hold one differing bit at most, so two of those three agree as well. A
fingerprint therefore gets 6 starts x 3 signatures of four whole segments (about 43 bits); those that share no signature with
another fingerprint are pruned.

Inside a signature's group the links are found without pairs: two fingerprints differ in at most 2 bits exactly if some value
lies within 1 bit of both. Each surviving fingerprint emits the values within 1 bit of it on the bits that the signature leaves
free; all that meet at a value are linked to the least of them, and the full Hamming check confirms each link. That is
linear in a group's size and keeps the linked components whole.

Components are found on links between distinct fingerprints only (copies share one): every round each fingerprint takes
the least label around it and that label's own label, until nothing changes; each round is written to the shared folder.

Defined results: null counts as empty; texts without words have fingerprint 0 and link like any other. A null doc_id
is never a component's id unless all of it are null; of several rows with the least id, the first in the table's file order leads.
Repeated rows have one fingerprint. Long texts are hashed in blocks of shingles. An empty table gives an empty result. Other columns of docs are
not read by near_duplicates; keep_leaders returns them unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import numbered, opened, slices, stage, stage_whole, texts, unstage

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 6
BITS = 64
EDGES = [round(BITS * i / SEGMENTS) for i in range(SEGMENTS + 1)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the hashes of the text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])[:n].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    stops = (ends[min(shingle, len(words)) - 1 :][:n] - 1).tolist()
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + (1 << 16)], stops[at : at + (1 << 16)])], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, __row, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(x) for x in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "__row", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "__row", "text").mapInArrow(run, "doc_id bigint, __row bigint, fp bigint")


def _mask(segments: list[int]) -> int:
    m = sum(((1 << EDGES[s + 1]) - (1 << EDGES[s])) for s in segments)
    return m - (1 << 64) if m >> 63 else m


def signatures() -> list[tuple[int, int]]:
    """(start and choice, mask of the bits that agree) of the chains within budget."""
    out = []
    for start in range(SEGMENTS):
        chain = [(start + k) % SEGMENTS for k in range(SEGMENTS - 1)]
        budgets = [(k + 1) * DISTANCE // SEGMENTS for k in range(SEGMENTS - 1)]
        sure = [s for s, b in zip(chain, budgets) if b == 0]
        loose = chain[len(sure) :]
        assert max(budgets) == 1
        out += [(start * SEGMENTS + k, _mask(sure + [s for s in loose if s != odd])) for k, odd in enumerate(loose)]
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of fingerprints at most DISTANCE bits apart that connect all that are."""
    marks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("long").alias("mask")) for k, m in signatures()])
    signed = distinct.select("fp", F.explode(marks).alias("s")).select("fp", F.col("s.k").alias("k"), F.col("s.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("s.mask")).alias("key"))
    met = signed.groupBy("k", "key").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least <> most").select("k", "key")
    chained = signed.join(met, ["k", "key"])
    # values within one bit on the bits that the signature leaves free
    bits = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)])
    free = F.filter(bits, lambda b: b.bitwiseAND(F.col("mask")) == 0)
    near = chained.select("fp", "k", "key", F.explode(F.concat(F.array(F.lit(0).cast("long")), free)).alias("flip")).select("fp", "k", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    meet = near.groupBy("k", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z").select("k", "value", "a")
    found = near.join(meet, ["k", "value"]).select("a", F.col("fp").alias("b")).filter("a <> b")
    return found.filter(hamming(F.col("a"), F.col("b")) <= DISTANCE).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of all nodes of edges (a, b). Labels only fall, so it ends; a path of n nodes takes about log n rounds."""
    both = stage(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stage(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least")).withColumnRenamed("a", "node")
        stepped = labels.join(around, "node").select("node", F.least("label", "least").alias("label"), F.col("label").alias("before"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stage(spark, stepped.join(hop, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "before"), "labels")
        changed = new.filter("label <> before").limit(1).count()
        unstage(spark, labels)
        labels = new.select("node", "label")
        if not changed:
            unstage(spark, both)
            return labels


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, __row, fp, component_id, leader_row (the first row with the component's id)."""
    return lead(spark, numbered(docs, "doc_id", "text"))


def lead(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """near_duplicates of rows that have their numbers."""
    marked = stage(spark, fingerprints(rows), "fingerprints")
    per = stage(spark, marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "__row")).alias("first")), "distinct")
    labels = components(spark, links(per.select("fp")))
    owned = per.join(labels, per["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    leaders = owned.groupBy("label").agg(F.min("first").alias("leader"))
    by_fp = owned.join(leaders, "label").select("fp", F.col("leader.doc_id").alias("component_id"), F.col("leader.__row").alias("leader_row"))
    return marked.join(by_fp, "fp").select("doc_id", "__row", "fp", "component_id", "leader_row")


def keep_leaders(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one of each component."""
    rows = stage_whole(spark, docs)
    kept = lead(spark, rows.select("doc.doc_id", "doc.text", "__row")).filter("__row = leader_row").select("__row")
    return opened(rows.join(kept, "__row", "left_semi"))
