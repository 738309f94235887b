"""From raw documents to token ids: quality classifier, exact dedup, SimHash near-dedup, source mix, BPE.

Each stage is one of the operators of loomgraph.llm, applied to all that the stage before it kept. Between two stages the rows are written as
Parquet to the shared folder and read again, so a lost executor costs no more than its tasks of the current stage.

Defined results: null texts count as empty; an empty table passes through all stages; repeated rows are copies (stage 2 keeps
one); of equal texts and of linked fingerprints the ties go as in the operators, and repeated rows draw alike in the mix; long texts pass whole; extra columns pass through unchanged, whatever their names, up to the last stage, which replaces columns named ids and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, exact_dedup, mixing, quality_classifier, simhash
from loomgraph.llm.common import documents, stage
from loomgraph.llm.queries import labels, vocabulary
from loomgraph.tables import unstage_read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_selected(docs, quality_classifier.train(spark, docs, labels(spark, sf_dir)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.keep_leaders(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_to_mix(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and their number; decoding them gives the text that a model sees."""
    return bpe.encode_documents(docs.select("doc_id", "source", "text"), vocabulary(), decoded=True).select("doc_id", "source", "ids", F.size("ids").alias("n_tokens"), "decoded")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("BPE", encode)]

#: SQL has neither the classifier nor XXH64; tests/llm compares the rows of run() with a brute-force run of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, apply) in enumerate(STAGES):
        made = apply(spark, docs, sf_dir)
        docs = stage(spark, made, f"pipeline-{k}")
        unstage_read(spark, made)  # the table of the stage before, and what this one kept of its rows
    return docs
