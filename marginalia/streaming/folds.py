"""Operators whose next decision depends on their own earlier ones: rate limit, cooldown, budgets, review loops.

Each is a small step function over a key's rows in time order. In batch, rows are dealt by key and
sorted, and a task streams them past the step with the state of one key at a time, so a key of any
size takes constant memory. In Structured Streaming the same step runs on keyed state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marginalia.functions.text import slices

Step = Callable[[list | None, tuple], tuple[list, tuple]]


def ordered_fold(rows: DataFrame, key: str, order: list[str], fields: list[str], step: Step, schema: str) -> DataFrame:
    """Run step(state, row) over each key's rows in order; it returns the new state and an output row."""
    spark = rows.sparkSession
    parsed = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(parsed)
    place = [key, *[f for f in fields if f != key]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, started = None, None, False
        for some in (s for batch in batches for s in slices(batch.columns)):
            out = []
            for row in zip(*(c.to_pylist() for c in some)):
                if not started or row[0] != current:
                    current, state, started = row[0], None, True
                state, result = step(state, row)
                out.append(result)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*place, *[c for c in order if c not in place]).repartition(n, key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, parsed)


def rate_limit_step(limit: int, window: float) -> Step:
    """Rows (key, id, seconds): allowed while fewer than `limit` allowed rows are younger than the window; denied rows do not count."""

    def step(state, row):
        hits = [t for t in state or [] if row[2] - t < window]
        allowed = len(hits) < limit
        return hits + [row[2]] * allowed, (row[0], row[1], allowed)

    return step


def cooldown_step(seconds: float) -> Step:
    """Rows (key, id, time, ok): attempts within `seconds` of a failure are suppressed; a success that runs clears it."""

    def step(state, row):
        failed = state[0] if state else None
        if failed is not None and row[2] - failed < seconds:
            return [failed], (row[0], row[1], True)
        return [None if row[3] else row[2]], (row[0], row[1], False)

    return step


def budget_step(per_task: int, per_session: int) -> Step:
    """Rows (session, id, task, tokens): allowed while task and session totals hold; denied requests use nothing.

    The state holds a total a task; a task's entry is added with its first request.
    """

    def step(state, row):
        used, tasks = (state[0], state[1]) if state else (0, {})
        mine = tasks.get(row[2], 0)
        if row[3] > max(per_task - mine, 0):
            reason = "task budget"
        elif row[3] > max(per_session - used, 0):
            reason = "session budget"
        else:
            reason, used = "reserved", used + row[3]
            tasks[row[2]] = mine + row[3]
        return [used, tasks], (row[0], row[1], reason == "reserved", reason, max(per_session - used, 0))

    return step


def settled_budget_step(per_task: int, per_session: int) -> Step:
    """Rows (session, id, time, kind, task, reservation, tokens): reservations, and the usage that settles them, early or late.

    A `reserve` row is allowed while task and session totals hold and stays open under its
    reservation. A `usage` row with an open reservation puts the true number in its place, in the
    task that reserved it, and closes it; any other usage is added to its own task. Totals never
    fall below zero. A reservation that comes again replaces what is open under its name.
    """

    def step(state, row):
        used, tasks, pending = state or [0, {}, {}]
        _, _, _, kind, task, reservation, tokens = row
        settles = kind == "usage" and reservation is not None and reservation in pending
        if settles:
            task, reserved = pending.pop(reservation)
            outcome, change = "settled", tokens - reserved
        elif kind == "usage":
            outcome, change = "added", tokens
        elif tokens > max(per_task - tasks.get(task, 0), 0):
            outcome, change = "task budget", 0
        elif tokens > max(per_session - used, 0):
            outcome, change = "session budget", 0
        else:
            outcome, change = "reserved", tokens
            if reservation is not None:
                pending[reservation] = [task, tokens]
        if outcome in ("settled", "added", "reserved"):
            used, tasks[task] = max(used + change, 0), max(tasks.get(task, 0) + change, 0)
        return [used, tasks, pending], (row[0], row[1], outcome, max(per_session - used, 0), len(pending))

    return step


def review_step(max_reviews: int = 3, max_corrections: int = 2) -> Step:
    """Rows (task, id, role, approved): a bounded loop of reviews and corrections.

    A review that does not approve asks for a correction while corrections are left, else the
    loop falls back to the first answer; rows after the end are ignored.
    """

    def step(state, row):
        status, reviews, corrections = state or ["open", 0, 0]
        action = "ignored"
        if status == "open" and row[2] == "review":
            reviews += 1
            if row[3]:
                status, action = "approved", "accept"
            elif corrections < max_corrections and reviews < max_reviews:
                status, action = "correcting", "correct"
            else:
                status, action = "fallback", "fall back"
        elif status == "correcting" and row[2] == "correct":
            corrections, status, action = corrections + 1, "open", "corrected"
        return [status, reviews, corrections], (row[0], row[1], action, status, reviews, corrections)

    return step


def stream_fold(rows: DataFrame, key: str, fields: list[str], step: Step, schema: str) -> DataFrame:
    """The step on keyed state of a stream: any state of lists, dictionaries, numbers and strings, held as JSON.

    Rows of a micro-batch are taken in the order of their third field; rows that come in a later
    micro-batch follow those before, whatever their time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = [f.split()[0] for f in schema.split(", ")]

    def run(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        table = pd.concat(list(frames)).sort_values([fields[2], fields[1]])
        out = []
        for row in table[fields].itertuples(index=False, name=None):
            held, result = step(held, row)
            out.append(result)
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=names)

    return rows.select(*fields).groupBy(key).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)
