"""The lineage journal: an append-only table of events, its pages and its provenance triples."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import turtle_literal
from loomgraph.schemas import EVENT_KINDS, EVIDENCE_TYPES, MOST_SUBJECT, MOST_SUMMARY
from loomgraph.tables import create, names

EVENTS = "event_id string, kind string, evidence_type string, summary string, subject string, snapshot_id string, previous_snapshot_id string, repository_revision string, recorded_at timestamp"
PUBLIC = ["event_id", "kind", "evidence_type", "summary", "subject", "snapshot_id", "previous_snapshot_id", "recorded_at"]


class Conflict(ValueError):
    """The journal has grown since the writer looked at it."""


def head(spark: SparkSession, folder: str) -> int:
    """The number of the last event; 0 in an empty journal."""
    found = [n for n in names(spark, folder) if n.endswith(".json") and n[:12].isdigit()]
    return int(found[-1][:12]) if found else 0


def record(spark: SparkSession, folder: str, kind: str, summary: str, evidence_type: str, subject: str | None = None, snapshot: str | None = None, after: int | None = None, rendered: str | None = None) -> str:
    """Append one event; its kind, type and lengths are checked before anything is written. Returns its id. Events are numbered files, each made only if its number is free: of several writers each gets a number
    of its own, and one that passes after (the head that it has seen) gets a Conflict if another came first. rendered: a folder for the journal's triples, written anew behind each event."""
    said, about = summary.strip(), (subject or "").strip()
    if kind not in EVENT_KINDS or evidence_type not in EVIDENCE_TYPES:
        raise ValueError("the kind of an event and its evidence type come from fixed lists")
    if not 1 <= len(said) <= MOST_SUMMARY or len(about) > MOST_SUBJECT:
        raise ValueError("a summary has 1 to 1000 characters, a subject at most 300")
    ident = str(uuid.uuid4())
    row = {"event_id": ident, "kind": kind, "evidence_type": evidence_type, "summary": said, "subject": about or None, "snapshot_id": snapshot}
    number = head(spark, folder) if after is None else after
    while True:
        at = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("t")).first()["t"]
        if create(spark, f"{folder}/{number + 1:012d}.json", json.dumps(row | {"recorded_at": at}) + "\n"):
            break
        if after is not None:
            raise Conflict(f"another event was recorded after number {after}")
        number += 1
    if rendered:
        turtle(read(spark, folder), F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).write.mode("overwrite").text(rendered)
    return ident


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All events; a line that is no event is an error, not a null."""
    return spark.read.schema(EVENTS).option("mode", "FAILFAST").json(folder)


def page(events: DataFrame, order: list[str], most: int = 50, evidence_type: str | None = None, public: list[str] = PUBLIC) -> DataFrame:
    """The last events, latest first, of one evidence type if it is given, with their public fields and whether there are more. The sort keeps one row more than asked for in each task."""
    if evidence_type is not None:
        events = events.filter(F.col("evidence_type") == evidence_type)
    late = [F.desc(c) for c in order]
    few = events.orderBy(*late).limit(most + 1)
    few = few.withColumn("position", F.row_number().over(Window.orderBy(*late))).withColumn("n", F.count("*").over(Window.partitionBy()))
    return few.filter(F.col("position") <= most).select("position", *public, (F.col("n") > most).alias("truncated"))


def turtle(events: DataFrame, at: Column, space: str = "urn:lineage:") -> DataFrame:
    """One line of Turtle per statement: the activity, its label, kind, evidence type and time, and what it has of subject and snapshots. at: the time as text."""
    subject = F.concat(F.lit(f"<{space}event-"), F.replace("event_id", F.lit("-"), F.lit("")), F.lit(">"))
    said = [
        ("a", F.lit("prov:Activity")), ("rdfs:label", turtle_literal(F.coalesce("summary", F.lit("")))), ("lin:eventKind", turtle_literal(F.coalesce("kind", F.lit("")))),
        ("lin:evidenceType", turtle_literal(F.coalesce("evidence_type", F.lit("")))), ("prov:generatedAtTime", turtle_literal(F.coalesce(at, F.lit("")))),
    ]
    extra = [("lin:subject", "subject"), ("lin:snapshotId", "snapshot_id"), ("lin:previousSnapshotId", "previous_snapshot_id"), ("lin:repositoryRevision", "repository_revision")]
    said += [(p, F.when(F.col(c) != "", turtle_literal(F.col(c)))) for p, c in extra if c in events.columns]
    lines = F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat_ws(" ", subject, F.lit(p), v, F.lit("."))) for p, v in said]))
    return events.filter(F.coalesce("event_id", F.lit("")) != "").select(F.explode(lines).alias("line"))
