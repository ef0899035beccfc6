"""Exact deduplication with a heavy-hitter split.

Every text becomes a SHA-256 digest of its normalised form (A-Z lower-cased, null as empty).
Misra-Gries summaries, one per partition and merged by addition, name every digest that may
hold more than ``rows / (counters + 1)`` rows. Those candidates are counted exactly; the
verified ones and their winners (at most ``counters`` rows) are broadcast, so rows of heavy
digests are settled where they lie. All other digests are settled by an ordinary shuffle
aggregation, whose groups are small by the summary's guarantee.

Defined results: null and empty texts are equal; a null id loses against any id; of rows that
repeat both id and text exactly one is kept; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import drop, fresh, keep, numbered, tables

#: Counters of a summary, and so the most digests that are ever broadcast.
COUNTERS = 1024


def digest(text: str | None) -> str:
    """What ``text_digests`` gives a text, for the driver: hex SHA-256 with A-Z lower-cased (bytes.lower touches ASCII only)."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).hexdigest()


def text_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256), one row per input row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # lower() would fold letters beyond A-Z too, which only texts with more octets than characters have
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return df.select(F.col(id_col).alias("doc_id"), F.sha2(lowered.cast("binary"), 256).alias("text_sha256"))


def absorb(held: dict, counts: list[tuple], counters: int) -> dict:
    """Misra-Gries in batches: add the counts, then lower all counters by the first that must go.

    At most ``counters`` values remain, each undercounted by rows / (counters + 1) at most; the bound
    also holds for summaries that are added up.
    """
    for v, n in counts:
        held[v] = held.get(v, 0) + n
    if len(held) <= counters:
        return held
    cut = sorted(held.values(), reverse=True)[counters]
    return {v: n - cut for v, n in held.items() if n > cut}


def heavy_candidates(digests: DataFrame, counters: int) -> DataFrame:
    """Digests that may have over rows / (counters + 1) rows: the ``counters`` largest of the added summaries."""

    def summarised(batches):
        held: dict = {}
        for b in batches:
            held = absorb(held, [(x["values"], x["counts"]) for x in b.column(0).value_counts().to_pylist()], counters)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["text_sha256", "held"])

    found = digests.select("text_sha256").mapInArrow(summarised, "text_sha256 string, held long")
    return found.groupBy("text_sha256").agg(F.sum("held").alias("held")).orderBy(F.desc("held"), "text_sha256").limit(counters)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    rows = keep(text_digests(df, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "digests")
    candidates = keep(heavy_candidates(rows, counters).select("text_sha256"), "candidates")
    best = F.max(F.struct("doc_id", "rid")).alias("best")
    winners = rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(best, F.count("*").alias("group_size"))
    #: verified: counted exactly, and over the share that the summary answers for
    floor = rows.count() // (counters + 1)
    heavy = keep(winners.filter(F.col("group_size") > floor), "winners")

    tagged = rows.join(F.broadcast(heavy), "text_sha256", "left")
    settled = tagged.filter(F.col("best").isNotNull())
    light = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    groups = light.groupBy("text_sha256").agg(best, F.count("*").alias("group_size"))
    shuffled = light.join(groups, "text_sha256").select(*settled.columns)
    return settled.unionByName(shuffled).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.rid") == F.col("rid")).alias("kept"),
        "text_sha256",
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    (row,) = fresh(df, "row")
    base = numbered(df, row)
    rows = base.select(F.struct(F.col(id_col).alias("id"), F.col(row).alias("row")).alias("id"), F.col(text_col).alias("text"))
    with tables() as meanwhile:
        lost = keep(exact_dedup(rows, "id", "text", counters).filter(~F.col("kept")).select(F.col("doc_id.row").alias(row)), "lost")
    drop(df.sparkSession, meanwhile[:-1])
    return base.join(lost, row, "left_anti").drop(row)
