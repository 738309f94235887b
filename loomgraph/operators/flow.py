"""Values that flow through ordered statements: which reads reach which conditions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators.folds import SEGMENT_BITS, segmented


def _apply(state: dict, step: tuple) -> None:
    """One statement on the state: variable -> the reads that are alive in it, and the variables of the state before that it still depends on."""
    kind, ident, variable, uses = step
    if kind == "read" and variable:
        state[variable] = ({ident}, set())
    elif kind == "assign":
        alive, old = set(), set()
        for u in uses or ():
            a, b = state.get(u, ((), {u}))
            alive |= set(a)
            old |= set(b)
        state[variable] = (alive, old)


def _summary(rows: list[tuple]) -> dict:
    state: dict = {}
    for row in rows:
        _apply(state, row)
    return {v: (sorted(alive), sorted(old)) for v, (alive, old) in state.items()}


def _compose(state: dict, done: dict) -> dict:
    """What is alive behind a segment, given what was before it."""
    moved = {v: sorted(set(alive).union(*(state.get(u, ()) for u in old))) for v, (alive, old) in done.items()}
    return {v: r for v, r in (state | moved).items() if r}


def _guards(state: dict, rows: list[tuple]) -> Iterator[tuple]:
    now = {v: (set(r), set()) for v, r in state.items()}
    for row in rows:
        kind, ident, _, uses = row
        if kind == "condition":
            seen: set = set()
            for u in uses or ():
                seen |= now.get(u, (set(), set()))[0]
            yield from ((r, ident) for r in sorted(seen))
        _apply(now, row)


def guarded(spark: SparkSession, statements: DataFrame, key: str, order: list[str], bits: int = SEGMENT_BITS) -> DataFrame:
    """key, read, condition: the conditions that a read's value reaches. Statements (kind, ident, variable, uses) are ordered inside a key (a method's body): a read
    begins a value in its variable and ends the ones that were there; an assignment passes on what its uses hold, and ends what its variable held if they don't hold it (a clean
    overwrite); a condition is reached by all that its uses hold. A condition sees the last statement of each variable before it, without a join of all with all: the reads
    that are alive are carried along the stream (an as-of join by union and last value), and segments of a key are summed up as functions of what is alive before them.

    Nulls: a read without a variable reaches nothing; null uses are none. Ties in the order are the caller's to break."""
    rows = statements.select(key, *order, "kind", "ident", "variable", "uses")
    ident = statements.schema["ident"].dataType.simpleString()
    return segmented(spark, rows, key, order, ["kind", "ident", "variable", "uses"], _summary, _compose, _guards, f"read {ident}, condition {ident}", start={}, bits=bits)
