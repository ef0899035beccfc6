"""Harmonic packing of token sequences, each worker by itself.

Class k holds pieces of at most capacity / k tokens, and a bin of class k is closed when it has k of
them; no bin is ever searched. A document first gives whole sequences. Of the rest, the largest piece of
exactly capacity // k tokens is cut off until what remains fills its class up to ``waste``. Bins that are
still open when a worker has read its rows (less than one per class) are laid end to end and cut at
the capacity; the last, shorter stretch is cut into powers of two, which need no padding.

Workers share nothing, so there is no shuffle, and a lost task is simply run again.

Defined results: a null text is empty and so consists of the end id alone; ids and ties play no part; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.tokens import encoder

CAPACITY = 4096
#: The largest class; shorter pieces join it.
CLASSES = 256
#: Share of a bin that may stay empty before a piece is cut to fit.
WASTE = 1 / 32

SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cuts(n: int, capacity: int, classes: int, waste: float) -> list[tuple[int, int]]:
    """(class, length) of the pieces of n tokens, in order."""
    out = [(1, capacity)] * (n // capacity)
    left = n % capacity
    while left:
        k = min(classes, capacity // left)
        if k == classes or left * k >= capacity * (1 - waste):
            return [*out, (k, left)]
        k = -(-capacity // left)
        while capacity // k > left:
            k += 1
        if k >= classes:
            return [*out, (min(classes, capacity // left), left)]
        out.append((k, capacity // k))
        left -= capacity // k
    return out


class Packer:
    """Bins of one worker. Pieces are (row, start, length, row's tokens, ids)."""

    def __init__(self, worker: int, capacity: int, classes: int, waste: float):
        self.capacity, self.classes, self.waste = capacity, classes, waste
        self.next = worker << 32
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for row, start, ids, total in pieces:
            yield row, start, len(ids), total, self.next, at, ids.tobytes()
            at += len(ids)
        self.next += 1

    def add(self, row, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for k, n in cuts(len(ids), self.capacity, self.classes, self.waste):
            held = self.open.setdefault(k, [])
            held.append((row, start, ids[start : start + n].copy() if k > 1 else ids[start : start + n], len(ids)))
            start += n
            if len(held) == k:
                yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """What is in open bins, end to end."""
        left = sum(len(p[2]) for held in self.open.values() for p in held)
        room, sequence = 0, []
        for k in sorted(self.open):
            for row, start, ids, total in self.open[k]:
                while len(ids):
                    if not room:
                        room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                        left -= room
                    part, ids = ids[:room], ids[room:]
                    sequence.append((row, start, part, total))
                    start, room = start + len(part), room - len(part)
                    if not room:
                        yield from self._close(sequence)
                        sequence = []


def pack(
    df: DataFrame, vocabulary: str, end_id: int = 2, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text",
    capacity: int = CAPACITY, classes: int = CLASSES, waste: float = WASTE,
) -> DataFrame:
    """One row per piece: the carried columns, start, length, doc_tokens, sequence_id, offset and ids.

    ids holds unsigned 32-bit little-endian integers. ``vocabulary`` is a tokenizers file.
    """
    rows = df.select(*carry, F.col(text_col).cast("string").alias("_text"))
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in carry]

    def packed(batches):
        packer, encode = Packer(TaskContext.get().partitionId(), capacity, classes, waste), encoder(vocabulary).encode
        types = None

        def batch(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True))
            own = [pa.array(c, t) for c, t in zip(zip(*cols[0], strict=True), types, strict=True)] if carry else []
            longs = [pa.array(c, pa.int64()) for c in cols[1:6]]
            return pa.RecordBatch.from_arrays([*own, *longs, pa.array(cols[6], pa.binary())], names)

        names = [*carry, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        found: list[tuple] = []
        for b in batches:
            types = [b.column(i).type for i in range(len(carry))]
            own = list(zip(*(b.column(i).to_pylist() for i in range(len(carry))), strict=True))
            ids, offsets = encode(b.column(len(carry)))
            for i, row in enumerate(own):
                found += packer.add(row, np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4"))
                if len(found) >= 4096:
                    yield batch(found)
                    found = []
        found += packer.finish()
        for i in range(0, len(found), 4096):
            yield batch(found[i : i + 4096])

    return rows.mapInArrow(packed, ", ".join(f"`{c}` {t}" for c, t in kinds) + ", " + SCHEMA)
