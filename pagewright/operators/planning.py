"""Plans of upload steps from the response to a mismatch of chapters and tracks.

A step has its chapter index (the chapter's order, a place, or a number after all chapters for a step without
text), its track, and the span of chapters that it holds. Responses: ``cancel`` makes no step, ``single_lesson`` one
of all chapters with the first track, ``pair_accept`` pairs by position and adds a step for each further track,
``pair_drop`` pairs by position and drops the longer side's rest, ``split_proportional`` packs chapters onto tracks.

Defined results: a response that needs what a book lacks makes no step and is named by ``plan_errors``; a null or
unknown response makes no step; books without chapters or tracks do not fail the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.matching import apart, proportional_pack

_STEP = ["chapter_index", "track", "degraded", "first_chapter", "end_chapter"]


def _counted(chapters: DataFrame, tracks: DataFrame, decisions: DataFrame, book: str, order: str) -> DataFrame:
    """(book, response, chapters, tracks, base) with the first free chapter index as base."""
    c = chapters.groupBy(book).agg(F.count("*").alias("_c"), (F.max(order) + 1).cast("long").alias("_base"))
    t = tracks.groupBy(book).agg(F.count("*").alias("_t"))
    return decisions.select(book, "response").join(c, book, "left").join(t, book, "left").fillna(0, ["_c", "_t", "_base"])


def plan_steps(chapters: DataFrame, tracks: DataFrame, decisions: DataFrame, book: str, position: str, order: str, chars: str, seconds: str) -> DataFrame:
    """(book, chapter_index, track, degraded, first_chapter, end_chapter): the steps of each decided book.

    ``decisions`` has one row per book: book and response. ``position`` numbers chapters and tracks from 0 without
    gaps, ``order`` is the chapters' own numbering, which may have gaps.
    """
    k = apart(_counted(chapters, tracks, decisions, book, order), book)
    c, t = chapters.select(book, position, order), tracks.select(book, position)
    place = F.col(position).cast("long")

    def steps(df: DataFrame, index, track, degraded, first, end) -> DataFrame:
        values = [x.cast(kind).alias(n) for n, x, kind in zip(_STEP, (index, track, degraded, first, end), ("long", "long", "boolean", "long", "long"), strict=True)]
        return df.select(book, *values)

    zero = F.lit(0)
    single = steps(k.filter("response = 'single_lesson' AND _t > 0"), zero, zero, F.lit(True), zero, F.col("_c"))
    paired = c.join(k, book).filter((F.col("response") == "pair_accept") | ((F.col("response") == "pair_drop") & (place < F.col("_t"))))
    paired = steps(paired, F.col(order), place, F.lit(False), place, place + 1)
    further = t.join(k, book).filter((F.col("response") == "pair_accept") & (place >= F.col("_c")))
    further = steps(further, F.col("_base") + place - F.col("_c"), place, F.lit(True), zero, zero)
    split = k.filter("response = 'split_proportional' AND _c > 0 AND _t > 0").select(book)
    packed = apart(proportional_pack(chapters.join(split, book, "left_semi"), tracks.join(split, book, "left_semi"), book, position, chars, seconds), book)
    first, end = F.col("first_chapter"), F.col("end_chapter")
    packed = steps(packed, F.col("track"), F.col("track"), first == end, first, end)
    return single.unionByName(paired).unionByName(further).unionByName(packed)


def with_bodies(steps: DataFrame, chapters: DataFrame, book: str, position: str, text: str) -> DataFrame:
    """Adds chapters (their count) and body: the step's chapters in order, a single space for a step without any."""
    held = F.when(F.col("end_chapter") > F.col("first_chapter"), F.sequence("first_chapter", F.col("end_chapter") - 1))
    spread = steps.select(book, *_STEP, F.explode_outer(held).alias("_p"))
    rows = spread.join(chapters.select(book, F.col(position).cast("long").alias("_p"), F.col(text).alias("_text")), [book, "_p"], "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_text")))), lambda x: x["_text"])  # one step's chapters
    out = rows.groupBy(book, *_STEP).agg(F.count("_p").alias("chapters"), F.array_join(ordered, "\n\n").alias("body"))
    return out.withColumn("body", F.when(F.col("chapters") > 0, F.col("body")).otherwise(" "))


def plan_errors(chapters: DataFrame, tracks: DataFrame, decisions: DataFrame, book: str, order: str) -> DataFrame:
    """(book, error) of the books whose response needs chapters or tracks that are not there."""
    error = F.when((F.col("response") == "single_lesson") & (F.col("_t") == 0), "a single lesson needs a track").when(
        (F.col("response") == "split_proportional") & ((F.col("_t") == 0) | (F.col("_c") == 0)), "a split needs chapters and tracks"
    )
    return _counted(chapters, tracks, decisions, book, order).select(book, error.alias("error")).filter("error IS NOT NULL")
