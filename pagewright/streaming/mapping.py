"""Mapping changes as a stream: gathered until they pause, applied in order against expected numbers.

A book's changes are held until no further one can come within the quiet period, or until the longest wait after the first of them; then
they are applied in their order. The first that fails ends its batch: those behind it are answered without being tried. Each book keeps its
mapping, its parked tracks, the number of its last change and the changes that wait, and nothing else.

The watermark says what may still come: changes that arrive later than it are left out by Spark. Apart from those the answers are the
same as ``batched_log`` gives over the same changes at once, whatever the micro-batches are and wherever the stream is stopped and restarted. It needs the
RocksDB state store.

Defined results: a change without a time is left out; changes of one time go in the order of seq; null numbers are stale, null kinds, chapters and
tracks unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewright.operators.events import _change, folded_in_order

ANSWER = "book long, seq long, batch long, op_id long, accepted boolean, error string, mapping string"
COLUMNS = [c.split(" ")[0] for c in ANSWER.split(", ")]


class Book:
    """A book's mapping and the batch that is open; times in milliseconds."""

    def __init__(self, tracks: int, quiet: int, longest: int):
        self.tracks, self.quiet, self.longest = tracks, quiet, longest
        self.held: dict[int, int | None] = {i: i for i in range(tracks)}
        self.parked: set[int] = set()
        self.op_id, self.opened, self.last, self.failed = 0, None, None, False

    def opens(self, at: int) -> bool:
        """Whether a change at this time is the first of a batch."""
        return self.opened is None or at - self.last >= self.quiet or at - self.opened >= self.longest

    def apply(self, at: int, seq: int, expected: int | None, kind: str | None, chapter: int | None, track: int | None) -> dict:
        if self.opens(at):
            self.opened, self.failed = at, False
        self.last = at
        if self.failed:
            error = "not tried"
        else:
            error = _change(self.held, self.parked, kind, chapter, track, self.tracks) if expected == self.op_id + 1 else "stale"
        self.failed = error is not None
        self.op_id += error is None
        shown = ",".join(f"{c}:{'' if t is None else t}" for c, t in sorted(self.held.items()))
        return {"seq": seq, "batch": self.opened, "op_id": self.op_id, "accepted": error is None, "error": error, "mapping": shown}


def _changes(ops: DataFrame) -> DataFrame:
    at = F.unix_millis(F.col("at").cast("timestamp"))
    return ops.filter("at is not null").select(F.col("book").cast("long").alias("book"), at.alias("ms"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("long").alias(c) for c in ("expected", "chapter", "track")], "kind", "at")


def batched_log(ops: DataFrame, tracks: int, quiet: timedelta, longest: timedelta) -> DataFrame:
    """Answers to a table of changes (book, seq, at, expected, kind, chapter, track)."""
    own = (tracks, *(int(x.total_seconds() * 1000) for x in (quiet, longest)))

    def fold() -> Callable[[dict], dict | None]:
        book = Book(*own)
        return lambda r: {"book": r["book"], **book.apply(r["ms"], r["seq"], r["expected"], r["kind"], r["chapter"], r["track"])} if r else None

    return folded_in_order(_changes(ops).drop("at"), "book", ["ms", "seq"], fold, ANSWER)


class Gathered(StatefulProcessor):
    def __init__(self, tracks: int, quiet: int, longest: int):
        self.own = (tracks, quiet, longest)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "op_id long, opened long, last long, failed boolean")
        self.mapping = handle.getMapState("mapping", "chapter long", "track long")
        self.parked = handle.getMapState("parked", "track long", "one boolean")
        self.waiting = handle.getMapState("waiting", "ms long, seq long, nth long", "expected long, kind string, chapter long, track long")

    def _book(self) -> Book:
        book = Book(*self.own)
        if self.numbers.exists():
            book.op_id, book.opened, book.last, book.failed = self.numbers.get()
            book.held = {c[0]: t[0] for c, t in self.mapping.iterator()}
            book.parked = {t[0] for t in self.parked.keys()}  # noqa: SIM118  not a dictionary
        return book

    def _put(self, book: Book) -> None:
        self.numbers.update((book.op_id, book.opened, book.last, book.failed))
        for c, t in book.held.items():
            self.mapping.updateValue((c,), (t,))
        self.parked.clear()
        for t in book.parked:
            self.parked.updateValue((t,), (True,))

    def _drained(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        """Apply every batch to which nothing can be added any more; wait for the rest."""
        book = self._book()
        ops = sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator()), key=lambda x: x[0])
        # how many from the start are of batches that have ended
        ended, opened, last = 0, book.opened, book.last
        for i, ((ms, _, _), _) in enumerate(ops):
            if opened is not None and (ms - last >= book.quiet or ms - opened >= book.longest) and ms <= watermark:
                ended, opened = i, ms
            opened = ms if opened is None else opened
            last = ms
        if ops and watermark >= min(last + book.quiet, opened + book.longest) and watermark > last:
            ended = len(ops)
        out = []
        for (ms, seq, nth), (expected, kind, chapter, track) in ops[:ended]:
            out.append({"book": key[0], **book.apply(ms, seq, expected, kind, chapter, track)})
            self.waiting.removeKey((ms, seq, nth))
        if out:
            self._put(book)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ended < len(ops):
            self.handle.registerTimer(max(watermark + 1, min(ops[-1][0][0] + book.quiet, ops[ended][0][0] + book.longest)))
        if out:
            frame = pd.DataFrame(out, columns=COLUMNS)
            yield frame.astype({"error": object})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                nth = 0
                while self.waiting.containsKey((int(r.ms), int(r.seq), nth)):
                    nth += 1
                kind = None if pd.isna(r.kind) else r.kind
                self.waiting.updateValue((int(r.ms), int(r.seq), nth), (whole(r.expected), kind, whole(r.chapter), whole(r.track)))
        yield from self._drained(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._drained(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def mapping_stream(ops: DataFrame, tracks: int, quiet: timedelta, longest: timedelta, late: str = "1 minute") -> DataFrame:
    """Answers to a stream of changes (book, seq, at, expected, kind, chapter, track), in append mode."""
    own = (tracks, *(int(x.total_seconds() * 1000) for x in (quiet, longest)))
    changes = _changes(ops).withWatermark("at", late)
    return changes.groupBy("book").transformWithStateInPandas(Gathered(*own), ANSWER, "append", "EventTime")
