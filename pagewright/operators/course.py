"""Statistics of a course from its lessons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def course_stats(lessons: DataFrame, course: str, words: str, percent: str, duration: str) -> DataFrame:
    """Lesson count, sums (null where nothing is known), and progress weighted by words.

    A lesson without a word count weighs the mean of the known positive ones, or 1; lessons without a percentage are
    left out of the mean but counted in the total; read lessons have 100 percent.
    """
    known = F.when(F.col(words) > 0, F.col(words))
    means = lessons.groupBy(course).agg(F.coalesce(F.avg(known), F.lit(1.0)).alias("_mean"))
    weight = F.coalesce(known.cast("double"), F.col("_mean"))
    pct = F.col(percent)
    held = F.when(pct.isNotNull(), weight)
    return lessons.join(means, course).groupBy(course).agg(
        F.count("*").alias("lessons"), F.sum(words).alias("total_words"), F.sum(duration).alias("total_duration"),
        F.count_if(pct >= 100).alias("lessons_read"), F.round(F.sum(held * pct) / F.sum(held)).cast("long").alias("progress"),
    )


def with_header(stats: DataFrame, header: DataFrame, course: str, columns: list[str]) -> DataFrame:
    """The header's values where it has them, else the sums."""
    own = header.select(course, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = stats.join(own, course, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def last_good(fetches: DataFrame, key: str) -> DataFrame:
    """(key, view, fetched_at, error): what is shown after all fetches (key, at, seq, outcome, view), in a table or a stream.

    The view is the last one that came; an error keeps it, a course that is gone takes it away until another comes. error is the outcome of the
    last fetch where that was not ok. Streams give it in complete or update mode.
    """
    order = F.struct("at", "seq")
    ok, gone = F.when(F.col("outcome") == "ok", order), F.when(F.col("outcome") == "gone", order)
    rows = fetches.groupBy(key).agg(
        F.max_by(F.struct("view", "at"), ok).alias("_v"), F.max(ok).alias("_ok"), F.max(gone).alias("_gone"), F.max_by("outcome", order).alias("_last")
    )
    shown = F.col("_ok").isNotNull() & (F.col("_gone").isNull() | (F.col("_ok") > F.col("_gone")))
    return rows.select(key, F.when(shown, F.col("_v.view")).alias("view"), F.when(shown, F.col("_v.at")).alias("fetched_at"), F.when(F.col("_last") != "ok", F.col("_last")).alias("error"))


def must_fetch(fetched_at: Column, now: Column, forced: Column, stale: str = "INTERVAL 15 MINUTES") -> Column:
    """Whether a view is asked for again: by force, where there is none, or where it is as old as ``stale``."""
    return forced | fetched_at.isNull() | (fetched_at + F.expr(stale) <= now)
