"""Mixing sources to target weights by multinomial draws over fixed-length blocks.

1. The words of each source, its documents in a fixed hashed order, are cut into blocks of
   ``block_words``; a document's place is a prefix sum in two levels of hashed buckets, so that no source is
   one task's work.
2. Targets follow the weights; none is above ``most_repeats`` times its source, the excess being shared
   out again by weight. A source's target is so many slots, passes over all of its blocks and then a part
   of a last pass, whose last block is cut so that the target is met to the word.
3. Each output shard draws its sources' slot counts from a multinomial law, seeded by the shard alone.
   What all shards together have drawn of a source too often goes, slot by slot, to the sources drawn
   too rarely, so the totals are exact and every shard still mixes at random.
4. The n-th slot of a source takes the block at index permutation(n), a keyed Feistel permutation of the
   block indices, another for each pass; slots and blocks are joined by (source, index).

Defined results: a null source is a source, the last; null and empty texts have no words and are taken 0
times; a source without words has target 0; rows that repeat are rows of their own; an empty table gives
an empty result; further columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import WORD, drop, fresh, keep, numbered, slices, tables

BLOCK_WORDS = 512
SHARD_SLOTS = 4096
#: Bytes of texts that are cut, and given back, at once.
AT_ONCE = 4_000_000
MOST_REPEATS = 3


def targets(sizes: list[int], weights: list[float], most: int = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * size, the excess reshared by weight."""
    out, free = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    left = float(sum(sizes))
    while free:
        per = left / sum(weights[i] for i in free)
        full = [i for i in free if per * weights[i] >= most * sizes[i]]
        if not full:
            for i in free:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to n - 1, at each index: a four-round Feistel network over the next even
    power of two, walked until it lands below n. ``back`` gives the inverse."""
    index, n, key = (np.asarray(x).astype(np.uint64) for x in np.broadcast_arrays(index, n, key))
    bits = np.ceil(np.log2(np.maximum(n.astype(float), 2)) / 2).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)

    def rounds(x, bits, low, key):
        left, right = x >> bits, x & low
        for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if back:
                left, right = right, left
            with np.errstate(over="ignore"):
                f = (right + key + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            f = (f ^ (f >> np.uint64(32))) & low
            if back:
                left = left ^ f
            else:
                left, right = right, left ^ f
        return (left << bits) | right

    out = rounds(index, bits, low, key)
    while (far := out >= n).any():
        out[far] = rounds(out[far], bits[far], low[far], key[far])
    return out.astype(np.int64)


def pass_key(seed: int, source: np.ndarray, turn: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (np.uint64(seed) + np.asarray(source).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ (
            (np.asarray(turn).astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
        )


class Plan:
    """The mixture: per source (by index) its name, size, target, blocks and slots."""

    def __init__(self, names: list, sizes: list[int], goal: list[float], block: int, seed: int):
        self.names, self.goal, self.block, self.seed = names, goal, block, seed
        self.size = np.array(sizes, np.int64)
        self.blocks = -(-self.size // block)
        words = np.array([round(x) for x in goal], np.int64)
        self.passes = words // np.maximum(self.size, 1)
        self.rest = words - self.passes * self.size  # words of the last pass
        self.short = block - (self.blocks * block - self.size)  # words of a source's last block
        some = np.maximum(self.blocks, 1)
        who = np.arange(len(names))
        self.short_at = permuted(some - 1, some, pass_key(seed, who, self.passes), back=True)
        last = -(-self.rest // block)
        last = np.where(self.short_at < last, -(-(self.rest + block - self.short) // block), last)
        self.slots = self.passes * self.blocks + np.where(self.rest > 0, np.minimum(last, self.blocks), 0)

    def block_of(self, source: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pass, block index, words taken of the block) of the nth slot of a source."""
        blocks = self.blocks[source]
        turn, at = nth // blocks, nth % blocks
        index = permuted(at, blocks, pass_key(self.seed, source, turn))
        holds = np.where(index == blocks - 1, self.short[source], self.block)
        before = at * self.block - np.where(self.short_at[source] < at, self.block - self.short[source], 0)
        last = turn == self.passes[source]
        return turn, index, np.where(last, np.minimum(holds, self.rest[source] - before), holds)


def sized(df: DataFrame, id_col: str, source_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """One row per input row: rid (``row_col``, or a new number), doc_id, source, size, and a hash for the order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return keep(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), rid.alias("rid")),
        "sizes",
    )


def placed(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """rows with begin, the number of words of their source before them."""
    buckets = max(1, n // 2000)
    high = max(1, math.isqrt(buckets))
    rows = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["name"])).drop("name", "source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(buckets)))

    def before(df: DataFrame, within: list[str], by: str) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("base", F.coalesce(F.sum("held").over(order), F.lit(0)))

    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("held")).withColumn("high", F.expr(f"bucket div {high}"))
    upper = before(sums.groupBy("source_no", "high").agg(F.sum("held").alias("held")), ["source_no"], "high").withColumnRenamed("base", "first")
    sums = before(sums, ["source_no", "high"], "bucket").join(upper.drop("held"), ["source_no", "high"])
    sums = sums.select("source_no", "bucket", (F.col("first") + F.col("base")).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "crc", "rid").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, ["source_no", "bucket"]).withColumn("begin", F.col("base") + F.sum("size").over(within) - F.col("size"))


def drawn_slots(spark, plan: Plan, shard_slots: int) -> DataFrame:
    """(shard, slot, source_no, pass, block, words): every slot of every output shard."""
    total = int(plan.slots.sum())
    shards = -(-total // shard_slots)
    spec = spark.sparkContext.broadcast(plan)  # a few numbers per source

    def draw(batches):
        p = spec.value.slots / max(total, 1)
        for pdf in batches:
            for k in pdf["id"].tolist():
                m = min(shard_slots, total - k * shard_slots)
                counts = np.random.default_rng([spec.value.seed, k]).multinomial(m, p)
                got = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": k, "source_no": got, "drawn": counts[got], "from": (np.cumsum(counts) - counts)[got]})

    tasks = max(1, min(shards, 10_000))
    draws = keep(spark.range(0, shards, 1, tasks).mapInPandas(draw, "shard long, source_no int, drawn long, from long"), "draws")
    got = np.zeros(len(plan.names), np.int64)
    for r in draws.groupBy("source_no").agg(F.sum("drawn").alias("n")).collect():  # one row per source
        got[r.source_no] = r.n
    over, under = np.maximum(got - plan.slots, 0), np.maximum(plan.slots - got, 0)
    over_base, under_upto = np.cumsum(over) - over, np.cumsum(under)
    extra = spark.sparkContext.broadcast((got, over_base, under_upto, under))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard and source
    based = draws.withColumn("base", F.coalesce(F.sum("drawn").over(before), F.lit(0))).repartition(tasks, "shard")

    def expand(batches):
        own, (had, over_base, under_upto, under) = spec.value, extra.value
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                source = np.full(r.drawn, r.source_no)
                nth = r.base + np.arange(r.drawn)
                m = min(shard_slots, total - r.shard * shard_slots)
                slot = permuted(r[3] + np.arange(r.drawn), m, pass_key(own.seed, r.shard, -1))
                far = nth >= own.slots[source]
                if far.any():  # drawn too often: these slots go to sources drawn too rarely
                    q = over_base[r.source_no] + nth[far] - own.slots[r.source_no]
                    to = np.searchsorted(under_upto, q, "right")
                    source[far], nth[far] = to, had[to] + q - (under_upto[to] - under[to])
                turn, block, words = own.block_of(source, nth)
                yield pd.DataFrame({"shard": r.shard, "slot": slot, "source_no": source.astype(np.int32), "pass": turn, "block": block, "words": words})

    return based.mapInPandas(expand, "shard long, slot long, source_no int, pass long, block long, words long")


def mix(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(1, 2, 3),
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, most_repeats: int = MOST_REPEATS, seed: int = 20_240_501, row_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans), planned by the driver from one row for each source: rows has rid, doc_id, crc, size, source_size and target of each input row; spans has the
    words taken: rid, shard, slot, pass, from_word and n_words."""
    spark = df.sparkSession
    rows = sized(df, id_col, source_col, text_col, row_col)
    held = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    held.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in held]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(held))], most_repeats)
    plan = Plan([r.source for r in held], sizes, goal, block_words, seed)
    table = [(i, r.source, int(r["size"]), goal[i]) for i, r in enumerate(held)]
    sources = spark.createDataFrame(table, "source_no int, name string, source_size long, target double")

    rows = keep(placed(rows, sources, sum(r.n for r in held)), "placed").drop("base", "bucket")
    slots = drawn_slots(spark, plan, shard_slots)
    some = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(begin div {block_words}, (begin + size - 1) div {block_words})")))
    lo = F.greatest(F.col("begin"), F.col("block") * block_words)
    pieces = some.select("source_no", "block", "rid", (lo - F.col("block") * block_words).alias("at"), (lo - F.col("begin")).alias("from_word"),
                         (F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words) - lo).alias("n"))
    # slots are as many as blocks, which Spark cannot foresee: never a side to broadcast
    spans = pieces.join(slots.hint("merge"), ["source_no", "block"]).select(
        "rid", "shard", "slot", "pass", "from_word", F.least("n", F.col("words") - F.col("at")).alias("n_words")
    )
    return rows, spans.filter("n_words > 0")


def taken_words(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of each row."""
    sums = spans.groupBy("rid").agg(F.sum("n_words").alias("taken"))
    return rows.join(sums, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def taken_texts(text: str, runs: list[tuple[int, int]]) -> list[str]:
    """The text from word a to before word b of each run (a, b); the whole text where a run has all words."""
    at = [(m.start(), m.end()) for m in re.finditer(WORD, text)]
    return [text if (a, b) == (0, len(at)) else text[at[a][0] : at[b - 1][1]] for a, b in runs]


def joined_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first word, number of words) of one pass as maximal runs (first, end)."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(spans):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], a + n)
        else:
            out.append((a, a + n))
    return out


def mixed_documents(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixture as rows of ``df``: one for each run of words that a pass takes of a row, its text cut to them.

    Rows taken in several passes come that often, rows without words not at all; ``length_col`` is set to the new
    text's length, other columns are as they were.
    """
    row, got = fresh(df, "row", "taken")
    base = numbered(df, row)
    with tables() as meanwhile:
        _, spans = mix(base, text_col=text_col, row_col=row, **options)
        taken = spans.groupBy("rid").agg(F.collect_list(F.struct("pass", "from_word", "n_words")).alias(got))  # a few for each block of a text
        taken = keep(taken.withColumnRenamed("rid", row), "taken")
    drop(df.sparkSession, meanwhile[:-1])
    rows = base.join(taken, row).select(*[F.col(f"`{c}`") for c in df.columns], got)
    out, text_no = df.schema, df.columns.index(text_col)

    def cut(batches):
        for b in (part for batch in batches for part in slices(batch, text_no, AT_ONCE)):
            texts = b.column(text_no).to_pylist()
            index, made = [], []
            for i, held in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for k in sorted({x["pass"] for x in held}):
                    own = taken_texts(texts[i], joined_runs([(x["from_word"], x["n_words"]) for x in held if x["pass"] == k]))
                    made += own
                    index += [i] * len(own)
            part = b.take(pa.array(index, pa.int64()))
            cols = {n: part.column(j) for j, n in enumerate(b.schema.names[:-1])}
            cols[text_col] = pa.array(made, pa.string())
            if length_col in cols:
                cols[length_col] = pa.array([len(t) for t in made], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return rows.mapInArrow(cut, out)
