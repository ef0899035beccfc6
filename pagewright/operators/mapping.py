"""Mappings of chapters to tracks: how they are seeded, and the plans that come of them.

A mapping has one row per chapter: book, the chapter's order (its own numbering, which may have gaps) and its track (a
position from 0, or null for none). ``position`` numbers the chapters that count, from 0 without gaps.

Defined results: books without chapters or without tracks get no mapping; a null or unknown response gives none; null
texts are empty; of several mapping rows of a chapter the least track counts; repeated chapters are the caller's to drop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators import matching as M


def eligible(chapters: DataFrame, skipped: DataFrame, uploaded: DataFrame, book: str, order: str) -> DataFrame:
    """Chapters that are not skipped, or are uploaded already."""
    flag = lambda df, name: df.select(book, order).distinct().withColumn(name, F.lit(True))
    rows = chapters.join(flag(skipped, "_s"), [book, order], "left").join(flag(uploaded, "_u"), [book, order], "left")
    return rows.filter(F.col("_s").isNull() | F.col("_u").isNotNull()).drop("_s", "_u")


def orphans(skipped: DataFrame, chapters: DataFrame, book: str, order: str) -> DataFrame:
    """Skips of chapters that are not there any more."""
    return skipped.join(chapters.select(book, order), [book, order], "left_anti")


def bounded_slice(chapters: DataFrame, ranges: DataFrame, book: str, chapter: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The chapters between each book's two boundary chapters (book, start, end), both included, and each book's error.

    Errors, the first that applies: empty (no chapters), missing and duplicate of the start, then of the end, reversed. Books
    with an error have no chapters in the slice.
    """
    places = chapters.groupBy(book, chapter).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    of = lambda name: places.select(book, F.col(chapter).alias(name), F.struct("_n", "_at").alias(f"_{name}"))
    some = chapters.select(book).distinct().withColumn("_some", F.lit(True))
    rows = ranges.select(book, "start", "end").join(some, book, "left").join(of("start"), [book, "start"], "left").join(of("end"), [book, "end"], "left")
    error = F.when(F.col("_some").isNull(), "empty")
    for side in ("start", "end"):
        error = error.when(F.col(f"_{side}").isNull(), f"missing {side}").when(F.col(f"_{side}._n") > 1, f"duplicate {side}")
    checked = rows.withColumn("error", error.when(F.col("_end._at") < F.col("_start._at"), "reversed"))
    good = checked.filter("error IS NULL").select(book, F.col("_start._at").alias("_lo"), F.col("_end._at").alias("_hi"))
    return chapters.join(good, book).filter(F.col(order).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi"), checked.select(book, "start", "end", "error")


def by_ranges(chapters: DataFrame, ranges: DataFrame, book: str, position: str, order: str, track: str = "track") -> DataFrame:
    """The mapping of ranges (book, track, first_chapter, end_chapter); chapters in none of them have no track."""
    first, end = F.col("first_chapter").cast("long"), F.col("end_chapter").cast("long")
    spread = ranges.select(book, F.col(track).cast("long").alias("track"), F.explode(F.when(end > first, F.sequence(first, end - 1))).alias(position))
    return chapters.select(book, position, order).join(spread, [book, position], "left").select(book, order, "track")


def seeded(
    chapters: DataFrame, tracks: DataFrame, decisions: DataFrame, book: str, position: str, order: str, chars: str, seconds: str, anchors: DataFrame | None = None
) -> DataFrame:
    """The mapping that each book's response gives: one lesson, proportional ranges, or pairs.

    Pairs are by position, or by ``anchors`` (book, chapter and track positions) in books that have any; the chapters
    between anchors then take the track before them, or none where the rest is dropped.
    """
    counted = tracks.groupBy(book).agg(F.count("*").alias("_t"))
    rows = chapters.join(decisions.select(book, "response"), book).join(counted, book)  # without tracks, no mapping
    place = F.col(position).cast("long")
    single = rows.filter("response = 'single_lesson'").select(book, order, F.lit(0).cast("long").alias("track"))
    split = decisions.filter("response = 'split_proportional'").select(book)
    of = chapters.join(split, book, "left_semi")
    packed = M.proportional_pack(of, tracks.join(split, book, "left_semi"), book, position, chars, seconds)
    packed = by_ranges(of.join(counted, book, "left_semi"), packed, book, position, order)
    pairs = rows.filter(F.col("response").isin("pair_accept", "pair_drop"))
    if anchors is not None:
        known = anchors.select(book, F.col("chapter").alias(position), "track")
        titled = pairs.join(known.select(book).distinct(), book, "left_semi").join(known, [book, position], "left")
        squeezed = M.squeezed(titled, book, position, "track")
        titled = squeezed.select(book, order, F.when(F.col("response") == "pair_accept", F.col("squeezed")).otherwise(F.col("track")).cast("long").alias("track"))
        pairs = pairs.join(known.select(book).distinct(), book, "left_anti")
    paired = pairs.select(book, order, F.when(place < F.col("_t"), place).alias("track"))
    out = single.unionByName(packed).unionByName(paired)
    return out if anchors is None else out.unionByName(titled)


def atom_starts(starts: DataFrame, chapters: DataFrame, tracks: DataFrame, book: str, position: str, order: str) -> DataFrame:
    """(book, track position, start, chapters): the last start of each track, as a position among the chapters.

    ``starts`` has book, track, order and seq. Starts of unknown tracks are left out; a start at a chapter that is not
    among them is none.
    """
    last = starts.groupBy(book, "track").agg(F.max_by(order, "seq").alias(order))
    last = last.join(chapters.select(book, order, F.col(position).alias("start")), [book, order], "left").select(book, F.col("track").alias(position), "start")
    counts = chapters.groupBy(book).agg(F.count("*").alias("chapters"))
    return tracks.select(book, position).join(last, [book, position], "left").join(counts, book)


def seeded_by_starts(starts: DataFrame, chapters: DataFrame, tracks: DataFrame, book: str, position: str, order: str) -> DataFrame:
    """The mapping of ranges that begin where the tracks' first words were found."""
    known = atom_starts(starts, chapters, tracks, book, position, order)
    ranges = M.anchored_ranges(known, book, position, "start", "chapters")
    return by_ranges(chapters.join(tracks.select(book).distinct(), book, "left_semi"), ranges, book, position, order, position)


def parked(tracks: DataFrame, mapping: DataFrame, book: str, position: str) -> DataFrame:
    """Tracks that no chapter has."""
    return tracks.join(mapping.select(book, F.col("track").alias(position)), [book, position], "left_anti")


def mapping_errors(chapters: DataFrame, tracks: DataFrame, mapping: DataFrame, book: str, position: str, order: str) -> DataFrame:
    """(book, error): why a mapping cannot be planned, by the first chapter that stands in the way."""
    found = mapping.groupBy(book, order).agg(F.min("track").alias("track"), F.lit(True).alias("_m"))
    rows = chapters.select(book, position, order).join(found, [book, order], "left")
    there = tracks.select(book, F.col(position).alias("track"), F.lit(True).alias("_t"))
    rows = rows.join(there, [book, "track"], "left")
    error = F.when(F.col("_m").isNull(), "no entry").when(F.col("track").isNotNull() & F.col("_t").isNull(), "unknown track")
    rows = rows.withColumn("error", error).filter("error IS NOT NULL")
    return rows.groupBy(book).agg(F.min_by("error", position).alias("error"))


def plan_of(
    mapping: DataFrame, parking: DataFrame, chapters: DataFrame, every: DataFrame, tracks: DataFrame, book: str, position: str, order: str, text: str
) -> DataFrame:
    """Steps (book, chapter_index, track, degraded, chapters, body) of the books whose mapping has no error.

    A run of chapters with one track is a step; chapters without a track are left out. Tracks that no chapter of
    ``every`` (skipped ones too) has and that are not in ``parking`` are steps of a single space, numbered after all chapters.
    """
    fine = M.apart(mapping.select(book).distinct().join(mapping_errors(chapters, tracks, mapping, book, position, order), book, "left_anti"), book)
    own = mapping.groupBy(book, order).agg(F.min("track").alias("track"))
    rows = chapters.join(fine, book, "left_semi").join(own, [book, order])
    w = Window.partitionBy(book).orderBy(position)
    new = ~F.col("track").eqNullSafe(F.lag("track").over(w)) | (F.row_number().over(w) == 1)
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w)).filter("track IS NOT NULL")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, F.coalesce(text, F.lit("")).alias("_x")))), lambda x: x["_x"]), "\n\n")  # a step's own
    steps = rows.groupBy(book, "_run", "track").agg(F.min_by(order, position).cast("long").alias("chapter_index"), F.count("*").alias("chapters"), body.alias("body"))
    steps = steps.select(book, "chapter_index", "track", F.lit(False).alias("degraded"), "chapters", "body")
    base = every.groupBy(book).agg((F.max(order) + 1).cast("long").alias("_base"))
    left = parked(tracks.join(fine, book, "left_semi"), mapping, book, position)
    left = left.join(parking.select(book, position), [book, position], "left_anti").join(base, book)
    place = F.col(position).cast("long")
    further = left.select(book, (F.col("_base") + place).alias("chapter_index"), place.alias("track"), F.lit(True).alias("degraded"), F.lit(0).cast("long").alias("chapters"), F.lit(" ").alias("body"))
    return steps.withColumn("track", F.col("track").cast("long")).unionByName(further)


def chosen_plan(kinds: DataFrame, plans: dict[str, DataFrame], book: str) -> DataFrame:
    """The steps of each book from the first of ``plans`` (in order) that the book has; ``kinds`` has book and a flag for each."""
    first = F.coalesce(*[F.when(F.col(k), F.lit(k)) for k in plans])
    picked = kinds.select(book, first.alias("kind"))
    kinds_of: dict[int, list[str]] = {}
    for k, df in plans.items():
        kinds_of.setdefault(id(df), []).append(k)  # a plan that serves several kinds is made once
    parts = [M.apart(plans[ks[0]], book).join(picked.filter(F.col("kind").isin(ks)), book) for ks in kinds_of.values()]
    return reduce(DataFrame.unionByName, parts)


def is_settled(touched: Column, track: Column, confidence: Column, least: float = 0.6) -> Column:
    """That a pair does not stand in the way of a start: touched by hand, without a track, or sure enough."""
    return F.coalesce(touched, F.lit(False)) | track.isNull() | F.coalesce(confidence >= least, F.lit(False))
