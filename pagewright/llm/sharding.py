"""Sharding by sampled splitters, with shards of near equal bytes.

1. A size-weighted sample of (key, salt) pairs, drawn by a hash so that reruns agree, gives quantile
   boundaries; the sample's size follows the number of ranges, not the rows.
2. Rows are range-partitioned at those boundaries. Ranges that come out overfull are sampled again and
   subdivided until none is; the salt subdivides even a single key that many rows share.
3. With the exact bytes of every range known, a running sum within each range places every row at
   its exact byte position; the shard is that position's share of the total. A range that crosses a
   shard's edge is cut there.

Shards are thus equal to within one row's size. Defined results: a null key sorts first; a null text
has size 16; rows that repeat are placed in any order among themselves; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.shared import drop, keep, tables

OVERHEAD = 16


def sized_rows(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes and the overhead of a row) and crc32 of each row's text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.col(key).alias("key"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )


def _sample(rows: DataFrame, rate: float, turn: int = 0) -> list[tuple]:
    """Size-weighted draw: a row stays with chance size * rate, decided by its hash."""
    chance = F.shiftrightunsigned(F.xxhash64("okey", "salt", F.lit(turn)), 11) / F.lit(float(1 << 53))
    return sorted({(r.okey, r.salt) for r in rows.filter(chance < F.col("size") * F.lit(rate)).select("okey", "salt").collect()})


def _ranged(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """range: how many cuts are at or below the row's (key, salt)."""
    keys, salts = np.array([k for k, _ in cuts] or [], object), np.array([s for _, s in cuts], np.int64)
    keys = keys.astype(np.int64) if all(isinstance(k, int) for k in keys) else keys
    held = rows.sparkSession.sparkContext.broadcast((keys, salts))

    @F.pandas_udf("int")
    def place(okey: pd.Series, salt: pd.Series) -> pd.Series:
        keys, salts = held.value
        own, salt = okey.to_numpy(keys.dtype), salt.to_numpy()
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        at = low.copy()
        for k in np.unique(low[high > low]).tolist():  # keys that are cut: the salt decides
            here = np.flatnonzero((low == k) & (high > k))
            at[here] = k + np.searchsorted(salts[k : high[here[0]]], salt[here], "right")
        return pd.Series(at.astype("int32"))

    return rows.withColumn("range", place("okey", "salt"))


def shard_by_bytes(df: DataFrame, shards: int = 40, key: str = "doc_id", text_col: str = "text", range_rows: int = 500_000, per_range: int = 24) -> DataFrame:
    """key, size, text_crc32, shard (0 to shards - 1) and slot (gapless in the shard, in key order)."""
    spark = df.sparkSession
    rows = sized_rows(df, key, text_col)
    lowest = F.lit("") if isinstance(rows.schema["key"].dataType, T.StringType) else F.lit(-(1 << 63))
    kind = "string" if isinstance(rows.schema["key"].dataType, T.StringType) else "long"
    rows = keep(
        rows.withColumn("okey", F.coalesce(F.col("key").cast(kind), lowest)).withColumn("salt", F.xxhash64("text_crc32", "size", F.monotonically_increasing_id())),
        "sized",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(4 * shards, -(-n // range_rows))
    drawn = _sample(rows, ranges * per_range / max(total, 1))
    cuts = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []
    rate, turn = ranges * per_range / max(total, 1), 0
    with tables() as made:
        while True:  # subdivide what came out overfull, whatever its largest row holds
            ranged = keep(_ranged(rows, cuts), "ranged")
            drop(spark, made[:-1])
            per = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("most")).collect()
            loads = {r["range"]: (r.b, r.n) for r in per}
            over = [r["range"] for r in per if r.b - r.most > 4 * total / ranges]
            if not over:
                break
            turn += 1
            more = {*cuts, *_sample(ranged.filter(F.col("range").isin(over)), rate, turn)[:: max(1, per_range // 2)]}
            if len(more) == len(cuts):  # nothing new was drawn
                rate *= 2
            cuts = sorted(more)
    bases, at_b, at_n = [], 0, 0
    for r in sorted(loads):
        bases.append((r, at_b, at_n))
        at_b, at_n = at_b + loads[r][0], at_n + loads[r][1]
    # one row per range: rows / range_rows of them, or four per shard
    base = F.broadcast(spark.createDataFrame(bases, "range int, base_b long, base_n long"))
    order = Window.partitionBy("range").orderBy("okey", "salt").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({"upto": F.sum("size").over(order), "nth": F.count("*").over(order)}).join(base, "range")
    placed = keep(
        placed.select(
            "key", "size", "text_crc32",
            F.expr(f"cast(least({shards - 1}, (2 * (base_b + upto) - size) * {shards} div {2 * max(total, 1)}) as int)").alias("shard"),
            (F.col("base_n") + F.col("nth") - 1).alias("position"),
        ),
        "placed",
    )
    first = F.broadcast(placed.groupBy("shard").agg(F.min("position").alias("first")))  # one row per shard
    return placed.join(first, "shard").select("key", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))
