"""Where a recording starts in a text: fuzzy title and transcript matches, and when one of them is sure.

Candidates are the chapters of one book, so joins are on the book; a book's chapters are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import is_generic_title, probe_length, title_score, transcript_score

TITLE_ACCEPT, TITLE_GAP = 0.70, 0.15
TRANSCRIPT_ACCEPT, TRANSCRIPT_GAP, LEAST_CHARS = 0.45, 0.15, 20


def ranked(scored: DataFrame, keys: list[str], order: str, top: int | None = None) -> DataFrame:
    """rank by score, the earlier chapter first among equals, and the next score below the best (gap)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), order)
    out = scored.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return out if top is None else out.filter(F.col("rank") <= top)


def best_titles(wanted: DataFrame, chapters: DataFrame, book: str, order: str) -> DataFrame:
    """The chapter of each wanted title: the best score, accepted from 0.70 on and 0.15 over the second."""
    pairs = wanted.join(chapters, book).withColumn("score", title_score(F.col("wanted"), F.col("title")))
    best = ranked(pairs, [book, "wanted"], order).filter("rank = 1")
    return best.withColumn("accepted", (F.col("score") >= TITLE_ACCEPT) & (F.col("gap") >= TITLE_GAP) & ~is_generic_title(F.col("wanted")))


def title_range(starts: DataFrame, ends: DataFrame, book: str, order: str) -> DataFrame:
    """First and last chapter by two titles: both accepted, not the same title, and the end not before the start."""
    s = starts.filter("accepted").select(book, F.col(order).alias("start_pos"), F.col("score").alias("_s"), F.col("wanted").alias("_first"))
    e = ends.filter("accepted").select(book, F.col(order).alias("end_pos"), F.col("score").alias("_e"), F.col("wanted").alias("_last"))
    both = s.join(e, book).filter("end_pos >= start_pos AND _first <> _last")
    return both.select(book, "start_pos", "end_pos", ((F.col("_s") + F.col("_e")) / 2).alias("confidence"))


def transcript_matches(transcripts: DataFrame, chapters: DataFrame, book: str, order: str, side: str = "head", top: int = 3, after: Column | None = None) -> DataFrame:
    """The ``top`` chapters whose head (tail, body) shares the longest text with the transcript."""
    length = probe_length(F.col("transcript"))
    probe = {"head": F.left("body", length), "tail": F.right("body", length), "body": F.col("body")}[side]
    pairs = transcripts.join(chapters, book)
    pairs = pairs if after is None else pairs.filter(after)
    return ranked(pairs.withColumn("score", transcript_score(F.col("transcript"), probe)), [book], order, top)


def decided(matches: DataFrame, book: str) -> DataFrame:
    """confident, unsure or poor (too little text) for the best match of each book."""
    best = matches.filter("rank = 1")
    verdict = (
        F.when(F.length("transcript") < LEAST_CHARS, "poor")
        .when((F.col("score") >= TRANSCRIPT_ACCEPT) & (F.col("gap") >= TRANSCRIPT_GAP), "confident")
        .otherwise("unsure")
    )
    return best.withColumn("verdict", verdict)
