"""Where a recording starts and ends in its book, as one decision.

Titles decide first. Where they do not, a book of one track is held against the transcripts of its head and tail, a book
of several tracks against the transcript of each track's head. Texts and titles come in their form for alignment.

``chapters`` has book, pos (from 0 without gaps), title and body; ``tracks`` has book, track (from 0 without gaps), title,
head and tail. Defined results: null and short texts are poor; null titles match nothing; of repeated rows of a track the
least text counts; books without chapters are never detected, books without tracks have no row; ties go to the earlier
chapter; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import probe_length, transcript_score
from pagewright.operators.alignment import LEAST_CHARS, TRANSCRIPT_ACCEPT, TRANSCRIPT_GAP, best_titles, title_range
from pagewright.operators.matching import anchored_ranges

START = "struct<track:bigint,pos:bigint>"


def boundaries(heard: DataFrame, chapters: DataFrame, keys: list[str], side: str = "head", least: str | None = None) -> DataFrame:
    """One row for each transcript (``keys``, the book first, and text): verdict, the best pos and score, and the top three.

    ``least`` names a column with the first chapter that may match; where that chapter is not there, all may match but none
    is sure. A best chapter is never sure if another one has its title, nor, but for a tail, if it is shorter than
    the transcript and not the longest: a title page.
    """
    book = keys[0]
    heard = heard.groupBy(*keys, *([least] if least else [])).agg(F.min("text").alias("text"))
    texts = chapters.select(book, "pos", F.coalesce("title", F.lit("")).alias("_title"), F.coalesce("body", F.lit("")).alias("_body"))
    rows = heard.withColumns({"_least": F.col(least) if least else F.lit(None).cast("long"), "_forced": F.lit(False)})
    if least:
        there = texts.select(F.col(book), F.col("pos").alias("_least"), F.lit(True).alias("_there")).distinct()
        rows = rows.join(there, [book, "_least"], "left").withColumn("_forced", F.col("_least").isNotNull() & F.col("_there").isNull())
    length = probe_length(F.col("text"))
    probe = {"head": F.left("_body", length), "tail": F.right("_body", length), "body": F.col("_body")}[side]
    allowed = F.col("_least").isNull() | F.col("_forced") | (F.col("pos") >= F.col("_least"))
    pairs = rows.filter(F.length("text") >= LEAST_CHARS).join(texts, book).filter(allowed)
    own = Window.partitionBy(*keys)
    best = own.orderBy(F.desc("_score"), "pos")
    scored = pairs.withColumns({"_score": transcript_score(F.col("text"), probe), "_chars": F.length("_body")})
    scored = scored.withColumns({
        "_same": F.count("*").over(Window.partitionBy(*keys, "_title")), "_longest": F.max("_chars").over(own),
        "_rank": F.row_number().over(best), "_next": F.coalesce(F.lead("_score").over(best), F.lit(0.0)),
    }).filter("_rank <= 3")
    page = F.lit(side != "tail") & (F.col("_chars") < F.length("text")) & (F.col("_chars") < F.col("_longest"))
    unsure = F.col("_forced") | ((F.col("_title") != "") & (F.col("_same") > 1)) | page
    sure = ~unsure & (F.col("_score") >= TRANSCRIPT_ACCEPT) & (F.col("_score") - F.col("_next") >= TRANSCRIPT_GAP)
    top = F.array_sort(F.collect_list(F.struct("_rank", "pos", F.col("_score").alias("score"))))  # three
    first = F.min_by(F.struct("pos", F.col("_score").alias("score"), sure.alias("sure")), "_rank")
    found = scored.groupBy(*keys).agg(top.alias("_top"), first.alias("_first"))
    verdict = F.when(F.coalesce(F.length("text"), F.lit(0)) < LEAST_CHARS, "poor").when(F.col("_first.sure"), "confident").otherwise("low")
    shown = F.transform(F.coalesce("_top", F.array().cast("array<struct<_rank:int,pos:bigint,score:double>>")), lambda x: F.struct(x["pos"].alias("pos"), x["score"].alias("score")))
    rows = heard.join(found, keys, "left")
    return rows.select(*keys, "text", verdict.alias("verdict"), F.col("_first.pos").cast("long").alias("pos"), F.col("_first.score").alias("score"), shown.alias("top"))


def _unusable(text: Column) -> Column:
    """Why a transcript cannot be used; null where it can."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, "empty").when(n < LEAST_CHARS, "content_poor")


def _decision(book: str, outcome: Column, reason: Column, source: str, start: Column, end: Column, confidence: Column, starts: Column) -> list[Column]:
    found = outcome == "detected"
    of = lambda c, name: F.when(found, c).alias(name)
    return [
        F.col(book), outcome.alias("outcome"), reason.alias("reason"), of(F.lit(source), "source"), of(start.cast("long"), "start_pos"), of(end.cast("long"), "end_pos"),
        of(confidence.cast("double"), "confidence"), F.coalesce(F.when(found, starts), F.array().cast(f"array<{START}>")).alias("starts"),
    ]


def by_ends(heard: DataFrame, chapters: DataFrame, book: str) -> DataFrame:
    """The decision for books of one track, from the transcripts of its two ends (book, head, tail)."""
    head = boundaries(heard.select(book, F.col("head").alias("text")), chapters, [book])
    after = head.select(book, F.col("text").alias("_head"), F.col("verdict").alias("_verdict"), F.col("pos").alias("_start"), F.col("score").alias("_score"))
    tails = heard.select(book, F.col("tail").alias("text")).join(after, book)
    sure = F.when(F.col("_verdict") == "confident", F.col("_start"))
    tail = boundaries(tails.withColumn("_from", sure), chapters, [book], "tail", "_from")
    count = chapters.groupBy(book).agg(F.count("*").alias("_n"))
    both = tail.join(after, book).join(count, book, "left")
    reason = F.coalesce(_unusable(F.col("_head")), _unusable(F.col("text")))
    apart = (F.col("_start") != F.col("pos")) | (F.coalesce("_n", F.lit(0)) <= 1)
    good = (F.col("_verdict") == "confident") & (F.col("verdict") == "confident") & apart
    outcome = F.when(reason.isNotNull(), "no_transcript").when(good, "detected").otherwise("low_confidence")
    none = F.lit(None).cast(f"array<{START}>")
    return both.select(*_decision(book, outcome, reason, "transcript", F.col("_start"), F.col("pos"), (F.col("_score") + F.col("score")) / 2, none))


def track_matches(heads: DataFrame, chapters: DataFrame, book: str) -> DataFrame:
    """The boundary of each track's head (book, track, text): by chapters' heads, and for later tracks that those leave
    unsure by whole chapters, if these are sure or score higher."""
    keys = [book, "track"]
    head = boundaries(heads, chapters, keys)
    again = head.filter("track > 0 AND verdict = 'low'").select(*keys, "text")
    body = boundaries(again, chapters, keys, "body").select(*keys, F.struct("verdict", "pos", "score").alias("_b"))
    better = F.coalesce((F.col("_b.verdict") == "confident") | (F.col("_b.score") > F.col("score")), F.lit(False))
    pick = lambda c: F.when(better, F.col(f"_b.{c}")).otherwise(F.col(c)).alias(c)
    return head.join(body, keys, "left").select(*keys, pick("verdict"), pick("pos"), pick("score"))


def by_tracks(matches: DataFrame, chapters: DataFrame, book: str) -> DataFrame:
    """The decision for books of several tracks, from each track's match (book, track, verdict, pos, score).

    A match is a track's start if it lies after all matches before it; the tracks' ranges say where the book's part begins
    and ends, the starts' mean score how sure that is.
    """
    count = chapters.groupBy(book).agg(F.count("*").alias("_chapters"))
    before = F.max("pos").over(Window.partitionBy(book).orderBy("track").rowsBetween(Window.unboundedPreceding, -1))
    rows = matches.withColumn("_before", before).withColumn("_start", F.when(F.col("_before").isNull() | (F.col("pos") > F.col("_before")), F.col("pos")))
    rows = rows.join(count, book, "left").fillna(0, ["_chapters"])
    ranges = anchored_ranges(rows, book, "track", "_start", "_chapters").withColumn("_some", F.col("end_chapter") > F.col("first_chapter"))
    accepted = F.col("_start").isNotNull()
    starts = F.array_sort(F.collect_list(F.when(accepted, F.struct(F.col("track").cast("long").alias("track"), F.col("_start").cast("long").alias("pos")))))
    g = ranges.groupBy(book).agg(
        F.bool_and(F.col("verdict") == "poor").alias("_poor"), F.bool_or(accepted).alias("_any"), F.avg(F.when(accepted, F.col("score"))).alias("_sure"), starts.alias("_starts"),
        F.min_by(F.when(F.col("_some"), F.col("first_chapter")), F.when(F.col("_some"), F.col("track"))).alias("_from"),
        F.max_by(F.when(F.col("_some"), F.col("end_chapter") - 1), F.when(F.col("_some"), F.col("track"))).alias("_to"),
    )
    outcome = F.when(F.col("_poor"), "no_transcript").when(F.col("_any") & F.col("_from").isNotNull(), "detected").otherwise("low_confidence")
    reason = F.when(F.col("_poor"), "content_poor")
    return g.select(*_decision(book, outcome, reason, "transcript", F.col("_from"), F.col("_to"), F.col("_sure"), F.col("_starts")))


def detected(tracks: DataFrame, chapters: DataFrame, book: str) -> DataFrame:
    """One row for each book with tracks: outcome (detected, low_confidence, no_transcript), reason, source, start_pos,
    end_pos, confidence and the starts of its tracks. Transcripts are compared only where titles do not decide."""
    ends = tracks.groupBy(book).agg(F.max("track").alias("_last"), F.min_by("title", "track").alias("_first_title"), F.max_by("title", "track").alias("_last_title"))
    named = ends.filter("_first_title <> _last_title AND _first_title <> '' AND _last_title <> ''")
    titles = chapters.select(book, "pos", F.coalesce("title", F.lit("")).alias("title"))
    side = lambda c: best_titles(named.select(book, F.col(c).alias("wanted")), titles, book, "pos")
    ranged = title_range(side("_first_title"), side("_last_title"), book, "pos")
    none = F.lit(None).cast(f"array<{START}>")
    by_title = ranged.select(*_decision(book, F.lit("detected"), F.lit(None).cast("string"), "title", F.col("start_pos"), F.col("end_pos"), F.col("confidence"), none))
    open_ = ends.join(ranged.select(book), book, "left_anti")
    single = tracks.join(open_.filter("_last = 0").select(book), book, "left_semi").groupBy(book).agg(F.min("head").alias("head"), F.min("tail").alias("tail"))
    several = tracks.join(open_.filter("_last > 0").select(book), book, "left_semi").select(book, "track", F.col("head").alias("text"))
    return by_title.unionByName(by_ends(single, chapters, book)).unionByName(by_tracks(track_matches(several, chapters, book), chapters, book))
