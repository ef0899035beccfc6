"""Silence runs in windowed sound, and the cuts between chapters that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(samples: DataFrame, file: str, position: str, amplitude: str, size: int) -> DataFrame:
    """Root mean square of each window of ``size`` samples; the last may be partial."""
    window = F.expr(f"{position} div {size}").alias("win")
    return samples.groupBy(file, window).agg(F.sqrt(F.avg(F.col(amplitude) * F.col(amplitude))).alias("rms"), F.count("*").alias("samples"))


def silence_runs(wins: DataFrame, file: str, threshold: float | Column, least: int) -> DataFrame:
    """(file, run, first_win, last_win, windows): islands of at least ``least`` windows at or below the threshold."""
    quiet = wins.filter(F.col("rms") <= threshold)
    w = Window.partitionBy(file).orderBy("win")
    island = F.col("win") - F.row_number().over(w)
    runs = quiet.withColumn("_g", island).groupBy(file, "_g").agg(F.min("win").alias("first_win"), F.max("win").alias("last_win"), F.count("*").alias("windows"))
    kept = runs.filter(F.col("windows") >= least).drop("_g")
    return kept.withColumn("run", F.row_number().over(Window.partitionBy(file).orderBy("first_win")).cast("long"))


def boundaries(runs: DataFrame, start: str, end: str, policy: str) -> DataFrame:
    """Cut places by policy: forward at the end of a run, backward at its start, drop at both."""
    cut = lambda c, kind: F.struct(F.col(c).alias("cut_at"), F.lit(kind).alias("kind"))
    cuts = {"forward": [cut(end, "cut")], "backward": [cut(start, "cut")], "drop": [cut(start, "drop_start"), cut(end, "drop_end")]}[policy]
    return runs.withColumn("_b", F.explode(F.array(*cuts))).select("*", "_b.cut_at", "_b.kind").drop("_b")
