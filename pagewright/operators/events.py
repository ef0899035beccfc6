"""Job events: validation of each job's sequence, upserts from events, and the optimistic log of mapping changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of events by what they do to a job.
TERMINAL = ("result", "cancelled", "needs_match")
DETECTION = "detecting_start"


def transition(state: Column, kind: Column, stage: Column) -> Column:
    """The state after an event: struct(life, detection, error). A rejected event leaves life and detection."""
    life, detection = state["life"], state["detection"]
    start = kind == "started"
    end = kind.isin(*TERMINAL)
    error = (
        F.when(start & (life == "running"), "duplicate start")
        .when(start & (life == "terminal"), "start after the end")
        .when(start, None)
        .when(end & (life == "waiting"), "end before the start")
        .when(end & (life == "terminal"), "second end")
        .when(end & (kind == "needs_match") & detection, "a detection cannot end this way")
        .when(end, None)
        .when(life == "waiting", "event before the start")
        .when(life == "terminal", "event after the end")
        .when((kind == "stage_changed") & ((stage == DETECTION) != detection), "stage of another kind of job")
        .when((kind == "detection_progress") & ~detection, "progress of another kind of job")
    )
    fine = error.isNull()
    return F.struct(
        F.when(fine & start, "running").when(fine & end, "terminal").otherwise(life).alias("life"),
        F.when(fine & start, F.coalesce(stage == DETECTION, F.lit(False))).otherwise(detection).alias("detection"),
        error.alias("error"),
    )


def validated(events: DataFrame, job: str, order: list[str], kind: str, stage: str, carry: list[str]) -> DataFrame:
    """Every event with its error (null where it is accepted) and the job's state after it.

    The first start is accepted, and after it the first end that its kind of job allows; these two say a job's state at
    every event, so a job's events stay spread. Equal events are numbered, and only the first of them can be accepted.
    """
    columns = list(dict.fromkeys([*order, *carry]))
    row = F.struct(*columns, F.col(kind).alias("_kind"), F.col(stage).alias("_stage"))
    each = events.select(F.col(job), row.alias("_r")).groupBy(job, "_r").agg(F.count("*").alias("_n"))
    each = each.select(job, "_r", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy")).select(job, F.struct("_r", "_copy").alias("_o"))
    kind_, stage_ = F.col("_o._r._kind"), F.col("_o._r._stage")
    detects = F.coalesce(F.col("_start._r._stage") == DETECTION, F.lit(False))

    def with_facts(facts: DataFrame) -> DataFrame:
        return each.join(facts.withColumnRenamed(job, "_job"), F.col(job).eqNullSafe(F.col("_job")), "left").drop("_job")

    starts = each.filter(kind_ == "started").groupBy(job).agg(F.min("_o").alias("_start"))
    allowed = kind_.isin(*TERMINAL) & (F.col("_o") > F.col("_start")) & ~((kind_ == "needs_match") & detects)
    facts = with_facts(starts).groupBy(job).agg(F.first("_start", ignorenulls=True).alias("_start"), F.min(F.when(allowed, F.col("_o"))).alias("_end"))
    waiting = F.col("_start").isNull() | (F.col("_o") <= F.col("_start"))
    running = F.col("_end").isNull() | (F.col("_o") <= F.col("_end"))
    before = F.struct(
        F.when(waiting, "waiting").when(running, "running").otherwise("terminal").alias("life"), (~waiting & detects).alias("detection"),
        F.lit(None).cast("string").alias("error"),
    )
    both = with_facts(facts).withColumn("_before", before).withColumn("_s", transition(F.col("_before"), kind_, stage_))
    return both.select(job, *[F.col(f"_o._r.{c}").alias(c) for c in columns], kind_.alias("kind"), F.col("_s.error").alias("error"), F.col("_s.life").alias("life"))


def sequence_verdicts(checked: DataFrame, job: str) -> DataFrame:
    """Per job: events, rejected ones, and whether it came to an end."""
    return checked.groupBy(job).agg(
        F.count("*").alias("events"), F.count("error").alias("rejected"), F.bool_or(F.col("life") == "terminal").alias("ended")
    )


def latest(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last values of each key: an upsert of all events."""
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_v")
    return events.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in columns])


def folded_in_order(df: DataFrame, key: str, order: list[str], fold: Callable[[], Callable[[dict], dict | None]], schema: str) -> DataFrame:
    """The rows that each key's fold gives, its rows in the order of ``order``.

    ``fold()`` starts a key; what it returns is called with every row and gives the row's answer, or None; a key's end
    calls it with an empty row. A task reads its keys' rows sorted, in batches, and holds one key's state, never its rows.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, types = None, None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if step is None or row[key] != at:
                    out.append(step({}) if step else None)
                    at, step = row[key], fold()
                out.append(step(row))
            types = _arrow_types(schema) if types is None else types
            yield _batch(out, names, types)
        if step is not None:
            yield _batch([step({})], names, types)

    rows = df.select(key, *[c for c in df.columns if c != key])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(answers, schema)


def _arrow_types(schema: str) -> list[pa.DataType]:
    of = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC")}
    return [of[c.strip().split(" ")[1]] for c in schema.split(", ")]


def _batch(rows: list[dict | None], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    kept = [r for r in rows if r is not None]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in kept], t) for n, t in zip(names, types, strict=True)], names)


def mapping_log(ops: DataFrame, book: str, tracks: int) -> DataFrame:
    """Apply a log of mapping changes per book: (book, seq, op_id, accepted, error) and the mapping after each.

    ``ops`` has seq, expected, kind, chapter, track. Only an operation whose expected number is one over the book's
    is applied. park sends a chapter's track to the parking lot, unpark brings a parked one to an empty chapter,
    reassign sets a known track, swap exchanges two chapters' tracks (``track`` names the other chapter). A null number
    is stale, a null chapter, track or kind unknown; operations of one seq go in the order of their other columns.
    """

    def fold() -> Callable[[dict], dict | None]:
        held: dict[int, int | None] = {i: i for i in range(tracks)}
        parked: set[int] = set()
        at = 0

        def step(r: dict) -> dict | None:
            nonlocal at
            if not r:
                return None
            error = _change(held, parked, r["kind"], r["chapter"], r["track"], tracks) if r["expected"] == at + 1 else "stale"
            at += error is None
            shown = ",".join(f"{c}:{'' if t is None else t}" for c, t in sorted(held.items()))
            return {"book": r["book"], "seq": r["seq"], "op_id": at, "accepted": error is None, "error": error, "mapping": shown}

        return step

    rows = ops.select(F.col(book).alias("book"), "seq", "expected", "kind", "chapter", "track")
    kind = rows.schema["book"].dataType.simpleString()
    return folded_in_order(rows, "book", ["seq", "expected", "kind", "chapter", "track"], fold, f"book {kind}, seq long, op_id long, accepted boolean, error string, mapping string")


def _change(held: dict, parked: set, kind: str | None, chapter: int | None, track: int | None, tracks: int) -> str | None:
    if chapter not in held:
        return "unknown chapter"
    if kind == "park":
        if held[chapter] is None:
            return "nothing to park"
        parked.add(held[chapter])
        held[chapter] = None
    elif kind == "unpark":
        if track not in parked:
            return "not parked"
        if held[chapter] is not None:
            return "target is not empty"
        parked.discard(track)
        held[chapter] = track
    elif kind == "reassign":
        if track is None or not 0 <= track < tracks:
            return "unknown track"
        parked.discard(track)
        held[chapter] = track
    elif kind == "swap":
        if track not in held:
            return "unknown chapter"
        held[chapter], held[track] = held[track], held[chapter]
    else:
        return "unknown operation"
    return None


def debounced(changes: DataFrame, key: str, at: str, quiet: timedelta, longest: timedelta) -> DataFrame:
    """(key, opened, changes): a batch ends when ``quiet`` passes without a change, or ``longest`` after it opened.

    Changes without a time are left out; changes of one time are in one batch.
    """

    def fold() -> Callable[[dict], dict | None]:
        state: dict = {}

        def step(r: dict) -> dict | None:
            done = None
            if state and (not r or r["at"] - state["last"] >= quiet or r["at"] - state["opened"] >= longest):
                done = {"key": state["key"], "opened": state["opened"], "changes": state["changes"]}
                state.clear()
            if r:
                state.update(key=r["key"], opened=state.get("opened", r["at"]), last=r["at"], changes=state.get("changes", 0) + 1)
            return done

        return step

    rows = changes.filter(F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"))
    kind = rows.schema["key"].dataType.simpleString()
    found = folded_in_order(rows, "key", ["at"], fold, f"key {kind}, opened timestamp, changes long")
    return found.select(F.col("key").alias(key), F.col("opened").cast(changes.schema[at].dataType).alias("opened"), "changes")


def stateful_validator(_key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """One job's events of a micro-batch, for applyInPandasWithState: the same rules as ``validated``."""
    life, detection = state.get if state.exists else ("waiting", False)
    out = []
    for pdf in rows:
        for r in pdf.sort_values(["ts", "event_id"]).itertuples(index=False):
            start, end = r.kind == "started", r.kind in TERMINAL
            error = None
            if start and life != "waiting":
                error = "duplicate start" if life == "running" else "start after the end"
            elif end and life != "running":
                error = "end before the start" if life == "waiting" else "second end"
            elif end and r.kind == "needs_match" and detection:
                error = "a detection cannot end this way"
            elif not start and not end and life != "running":
                error = "event before the start" if life == "waiting" else "event after the end"
            elif r.kind == "stage_changed" and (r.stage == DETECTION) != detection:
                error = "stage of another kind of job"
            elif r.kind == "detection_progress" and not detection:
                error = "progress of another kind of job"
            elif start:
                life, detection = "running", r.stage == DETECTION
            elif end:
                life = "terminal"
            out.append((r.job, r.event_id, r.kind, error, life))
    state.update((life, bool(detection)))
    yield pd.DataFrame(out, columns=["job", "event_id", "kind", "error", "life"])
