"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, strata: str, most: int, order: list) -> DataFrame:
    """At most ``most`` rows of ``df``, shared out evenly among the values of ``strata``.

    Rows are thinned by a hash of the ``order`` columns before they are ranked, so that no value's rows
    are sorted whole; reruns draw the same rows. Give it keys alone, not texts: ``texts_of`` fetches those.
    """
    sizes = df.groupBy(strata).agg(F.count("*").alias("_n"))
    values = max(1, sizes.count())
    share = max(1, most // values)
    rank = F.xxhash64(*order)
    chance = F.shiftrightunsigned(rank, 11) / F.lit(float(1 << 53))
    # the first row of every value stays whatever the chance, so that a value with a small share is not lost
    first = F.struct(rank, *order)
    sizes = sizes.join(df.groupBy(strata).agg(F.min(first).alias("_first")), strata)
    thinned = df.join(sizes, strata).filter((chance <= F.lit(2.0 * share) / F.col("_n")) | (first == F.col("_first"))).drop("_first")
    window = Window.partitionBy(strata).orderBy(rank, *order)
    return thinned.withColumn("_k", F.row_number().over(window)).filter(F.col("_k") <= share).drop("_n", "_k")


def texts_of(texts: DataFrame, drawn: DataFrame) -> DataFrame:
    """The rows of ``texts`` (doc_id, mark, text) that are in ``drawn`` (doc_id, mark, ...), at most a sample's rows."""
    return texts.join(F.broadcast(drawn), ["doc_id", "mark"])


def marked(df: DataFrame, *names: str) -> DataFrame:
    """doc_id, mark (a hash of the text) and the columns named: what a sample is drawn from."""
    return df.select("doc_id", F.xxhash64(F.col("text")).alias("mark"), *names)
