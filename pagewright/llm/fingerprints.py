"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` holds, for the code points of many texts laid end to end, the sums of code point times power of
the base, modulo a prime. Two entries give the hash of any span, so spans are compared in constant time and the
longest common extension of two places is found by binary search over hashes.

A fingerprint is eight hexadecimal digits of the text's length and sixteen of two whole-text hashes, then the
minima, in ``SLOTS`` hashed classes, of the hashes of all spans of ``SPAN`` code points (of the whole text
where it is shorter), four digits each. Equal texts have equal fingerprints.

Slots of the same class that agree in two fingerprints anchor a place of one text to a place of the other; so do the
two beginnings, and the two ends. Every anchor is extended to both sides as far as the texts are equal, found by
binary search over prefix hashes; likeness is the share of both texts' code points that these extensions cover.

An edited text needs the beginning of the next document, by ascending id. Documents are put into ranges of ids
whose bounds come from a mergeable quantile sketch; the first document of a range is also given to the
range before it. So there is one shuffle, of every text once, and no range grows with the table.

Defined results: a null text is empty; null ids come first; documents that share an id follow each other by
text, so equal rows are in any order among themselves; the next of the last document is the first one (of a
lone document: itself); two empty texts are alike (1); an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1_000_003, 998_244_353)
SPAN = 12
SLOTS = 64
#: Code points of texts that are worked on at once, with as many of edited texts; a longer text is worked on whole.
AT_ONCE = 750_000
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(k: int, n: int) -> np.ndarray:
    """BASES[k] ** i modulo PRIMES[k] for i up to n, made by doubling."""
    p = np.uint64(PRIMES[k])
    while len(_powers[k]) <= n:
        have = _powers[k]
        step = np.uint64(pow(BASES[k], len(have), PRIMES[k]))
        _powers[k] = np.concatenate([have, have * step % p])
    return _powers[k]


class Prefixes:
    """Prefix hashes of code points; span(i, j) is the hash of those from i to j, moved to a common power."""

    def __init__(self, points: np.ndarray, k: int = 0):
        self.k, self.n, self.p = k, len(points), np.uint64(PRIMES[k])
        terms = (points.astype(np.uint64) + np.uint64(1)) * powers(k, self.n)[: self.n] % self.p
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.sums %= self.p

    def span(self, i, j, top: int | None = None) -> np.ndarray:
        """``top`` must be the same for hashes that are compared, and no less than any i."""
        i, j = np.asarray(i), np.asarray(j)
        top = self.n if top is None else top
        return (self.sums[j] + self.p - self.sums[i]) % self.p * powers(self.k, top)[top - i] % self.p

    def equal(self, i, j, length) -> np.ndarray:
        return self.span(i, np.add(i, length)) == self.span(j, np.add(j, length))

    def common(self, i, j, most) -> np.ndarray:
        """Longest common extensions of the places i and j, at most ``most`` long."""
        low, high = np.zeros(np.shape(i), np.int64), np.array(most, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def common_before(self, i, j, most) -> np.ndarray:
        """The same to the left: how many code points before i and j are equal."""
        low, high = np.zeros(np.shape(i), np.int64), np.array(most, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(np.subtract(i, mid), np.subtract(j, mid), mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Marks:
    """Of texts laid end to end: their prefix hashes, heads (length and two hashes), slots, and where slots lie."""

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        flat = np.concatenate(texts) if texts else np.empty(0, np.uint32)
        self.prefixes, two = Prefixes(flat, 0), Prefixes(flat, 1)
        whole = [p.span(self.starts, self.ends) * np.uint64(self._undo(p, k)) % p.p for k, p in enumerate((self.prefixes, two))]
        self.heads = np.stack([self.sizes.astype(np.uint64), *whole], 1).astype(">u4")
        self.slots, self.places = self._minima(len(texts))

    @staticmethod
    def _undo(p: Prefixes, k: int) -> int:
        """Takes span()'s common power away: hashes then are the same wherever the text lies."""
        return pow(pow(BASES[k], p.n, PRIMES[k]), -1, PRIMES[k])

    def _minima(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        spans = np.maximum(self.sizes - SPAN + 1, np.minimum(self.sizes, 1))
        text = np.repeat(np.arange(n), spans)
        at = np.repeat(self.starts - (np.cumsum(spans) - spans), spans) + np.arange(len(text))
        p = self.prefixes
        h = p.span(at, np.minimum(at + SPAN, self.ends[text])) * np.uint64(self._undo(p, 0)) % p.p
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (h << np.uint64(21))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        slot = (h >> np.uint64(58)).astype(np.int64)
        value = ((h >> np.uint64(10)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        best = np.full(n * SLOTS, 0xFFFFFFFF, np.uint32)
        cell = text * SLOTS + slot
        np.minimum.at(best, cell, value)
        first = np.full(n * SLOTS, -1, np.int64)
        held = np.flatnonzero(value == best[cell])[::-1]  # the first place of a minimum is written last
        first[cell[held]] = at[held]
        low = np.where(best == 0xFFFFFFFF, 0xFFFF, ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)) % 0xFFFF).astype(np.uint16)
        return low.reshape(n, SLOTS), first.reshape(n, SLOTS)

    def as_text(self, i: int) -> str:
        return self.heads[i].tobytes().hex() + self.slots[i].astype(">u2").tobytes().hex()


def anchors(marks: Marks, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place, place) where texts a[i] and b[i] may be equal: agreeing slots, beginnings, and ends."""
    pair, slot = np.nonzero((marks.slots[a] == marks.slots[b]) & (marks.places[a] >= 0) & (marks.places[b] >= 0))
    every = np.arange(len(a))
    return (
        np.concatenate([pair, every, every]),
        np.concatenate([marks.places[a[pair], slot], marks.starts[a], marks.ends[a]]),
        np.concatenate([marks.places[b[pair], slot], marks.starts[b], marks.ends[b]]),
    )


def covered(n: int, pair: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each of n pairs the size of the union of its spans."""
    order = np.lexsort((begin, pair))
    pair, begin, end = pair[order], begin[order], end[order]
    shift = (pair * (end.max(initial=0) + 1)).astype(np.int64)  # each pair's spans in a stretch of their own
    reach = np.maximum.accumulate(np.concatenate([[0], end + shift]))[:-1]
    return np.bincount(pair, np.maximum(0, end + shift - np.maximum(begin + shift, reach)), n)


def likeness(marks: Marks, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the code points of texts a[i] and b[i] that the extensions of their anchors cover; 1 for equal texts."""
    pair, i, j = anchors(marks, a, b)
    # anchors at the same distance that lie within one extension give it again: one extension for a run of them
    order = np.lexsort((i, j - i, pair))
    pair, i, j = pair[order], i[order], j[order]
    left, right = np.empty(len(pair), np.int64), np.empty(len(pair), np.int64)
    waiting = np.arange(len(pair))
    spans = []
    while len(waiting):
        own, gap = pair[waiting], (j - i)[waiting]
        first = np.ones(len(waiting), bool)
        first[1:] = (own[1:] != own[:-1]) | (gap[1:] != gap[:-1])
        now = waiting[first]
        p, x, y = pair[now], i[now], j[now]
        right[now] = marks.prefixes.common(x, y, np.minimum(marks.ends[a[p]] - x, marks.ends[b[p]] - y))
        left[now] = marks.prefixes.common_before(x, y, np.minimum(x - marks.starts[a[p]], y - marks.starts[b[p]]))
        spans.append(now)
        reach = (i[now] + right[now])[np.cumsum(first) - 1]
        waiting = waiting[~first & (i[waiting] > reach)]
    done = np.concatenate(spans) if spans else np.empty(0, np.int64)
    p, x, y, back, on = pair[done], i[done], j[done], left[done], right[done]
    both = covered(len(a), p, x - back, x + on) + covered(len(a), p, y - back, y + on)
    total = marks.sizes[a] + marks.sizes[b]
    same = (marks.heads[a] == marks.heads[b]).all(1)
    return np.where(same, 1.0, both / np.maximum(total, 1))


def _bounds(ids: DataFrame, ranges: int) -> list[int]:
    """Lower bounds of all ranges of ids but the first, with near equal counts by a mergeable quantile sketch."""
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 20 * ranges).alias("at")).first().at
    return sorted(set(found or []))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = ids.count()
    ranges = ranges or max(1, math.isqrt(n) // 4)  # a range is streamed, so both the ranges and their rows may grow with the root of the table
    held = spark.sparkContext.broadcast(np.array(_bounds(ids, ranges), np.int64))  # one number for each range

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        place = np.searchsorted(held.value, doc_id.fillna(0).astype("int64").to_numpy(), "right") + 1
        return pd.Series(np.where(doc_id.notna(), place, 0).astype("int32"))  # null ids are a range of their own, the first

    order = [(x.r, x.first) for x in ids.withColumn("r", range_of("doc_id")).groupBy("r").agg(F.min("doc_id").alias("first")).orderBy("r").collect()]
    copies = [(first, order[i - 1][0]) for i, (_, first) in enumerate(order)]  # one row for each range
    give = F.broadcast(spark.createDataFrame(copies, "first long, before int"))
    placed = rows.withColumn("r", range_of("doc_id")).join(give, F.col("doc_id").eqNullSafe(F.col("first")), "left")
    places = "array(struct(r AS r, 0 AS tail), if(before IS NULL, null, struct(before AS r, 1 AS tail)))"
    sent = placed.select("doc_id", "text", F.expr(f"explode(filter({places}, x -> x IS NOT NULL)) AS at")).select("doc_id", "text", "at.r", "at.tail")
    ordered = sent.repartitionById(ranges + 1, F.col("r")).sortWithinPartitions("tail", "doc_id", "text").select("doc_id", "text", "tail")

    def work(batches):
        waiting: list = []  # rows that are not written yet; the last one's next is not known
        size, tail = 0, None
        for b in batches:
            for doc_id, text, is_tail in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if is_tail:
                    tail = text if tail is None else tail
                    continue
                waiting.append((doc_id, text))
                size += len(text)
                if size > AT_ONCE and len(waiting) > 1:
                    yield _edited(waiting, None)
                    waiting, size = waiting[-1:], len(text)
        if waiting:
            yield _edited(waiting, tail)

    return ordered.mapInArrow(work, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 4) code points give way to the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _edited(rows: list[tuple], tail: str | None) -> pa.RecordBatch:
    """Results of all rows but the last, and of the last too where ``tail`` follows it."""
    texts = [t for _, t in rows] + ([tail] if tail is not None else [])
    n = len(texts) - 1
    points = [code_points(t) for t in texts]
    edited, sha = [], []
    for i in range(n):
        k = len(points[i]) // 4
        edited.append(np.concatenate([points[i][: len(points[i]) - k], points[i + 1][:k]]))
        sha.append(hashlib.sha256(edited_text(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass")).hexdigest())
    marks = Marks([*points, *edited])
    at = np.arange(n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows[:n]], pa.int64()), pa.array([len(p) for p in points[:n]], pa.int64()), pa.array(sha, pa.string()),
            pa.array([marks.as_text(i) for i in range(n)], pa.string()), pa.array([marks.as_text(n + 1 + i) for i in range(n)], pa.string()),
            pa.array(likeness(marks, at, n + 1 + at), pa.float64()), pa.array(likeness(marks, at, at + 1), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
