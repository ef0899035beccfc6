"""Matching chapters to tracks: count classes, positional pairs, proportional and anchored packing, title anchors, buckets.

Every ordered computation is per book; a book's chapters and tracks are at most a few thousand, so the arrays that the
folds run over are bounded by a book and never by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import bigrams, dice_of, squashed

#: Condition, allowed responses, and the one chosen beforehand.
RESPONSES = (
    ("one_to_many", ["single_lesson", "cancel"], "single_lesson"),
    ("many_to_one", ["single_lesson", "cancel"], "single_lesson"),
    ("count_off", ["pair_accept", "pair_drop", "cancel"], "pair_accept"),
    ("many_to_few", ["split_proportional", "single_lesson", "cancel"], "split_proportional"),
    ("unalignable", ["single_lesson", "cancel"], "cancel"),
)


def count_class(chapters: Column, tracks: Column) -> Column:
    """The mismatch of two counts; null where they are equal and not zero."""
    low, high = F.least(chapters, tracks), F.greatest(chapters, tracks)
    return (
        F.when(low == 0, "unalignable")
        .when(chapters == tracks, None)
        .when((chapters == 1) & (tracks >= 3), "one_to_many")
        .when((tracks == 1) & (chapters >= 3), "many_to_one")
        .when(high - low <= 2, "count_off")
        .when((chapters > tracks) & (tracks >= 2) & (2 * chapters > 3 * tracks) & (chapters <= 30 * tracks), "many_to_few")
        .when(high > 3 * low, "unalignable")
        .otherwise("count_off")
    )


def allowed_responses(df: DataFrame, condition: str = "condition") -> DataFrame:
    """Adds options and preselect (a table of five rows is broadcast)."""
    table = df.sparkSession.createDataFrame(list(RESPONSES), f"{condition} string, options array<string>, preselect string")
    return df.join(F.broadcast(table), condition, "left")


def numbered(df: DataFrame, book: str, order: list, out: str) -> DataFrame:
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(book).orderBy(*order)) - 1).cast("long"))


def apart(df: DataFrame, book: str) -> DataFrame:
    """The same rows, made in a stage of their own: else all that is by book is one stage, and one task has the sorts of every part of a plan.

    Rows are dealt by another hash than joins use, as Spark leaves out a shuffle by ``book`` where rows are dealt so already.
    """
    return df.repartition(F.xxhash64(book))


def positional_pairs(chapters: DataFrame, tracks: DataFrame, book: str, position: str = "pos", equal_only: bool = True) -> DataFrame:
    """Chapters joined to the track of the same position; with ``equal_only`` just for books whose counts agree."""
    if not equal_only:
        return chapters.join(tracks, [book, position], "left")
    counts = [d.groupBy(book).agg(F.count("*").alias(f"_{k}")) for k, d in (("c", chapters), ("t", tracks))]
    same = counts[0].join(counts[1], book).filter("_c = _t").select(book)
    return chapters.join(same, book, "left_semi").join(tracks, [book, position])


def proportional_pack(chapters: DataFrame, tracks: DataFrame, book: str, position: str, chars: str, seconds: str) -> DataFrame:
    """(book, track, first chapter, end chapter) of every track: tracks' shares of the time against chapters' shares of the characters.

    A boundary inside a chapter goes to its nearer side, a track takes one chapter at least where any is left, and
    the last track takes the rest. Each boundary finds its chapter in one ordered pass over the book's chapters and
    boundaries; a fold over the book's tracks then only carries the next free chapter.
    """
    every, upto = Window.partitionBy(book), Window.partitionBy(book).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    c = chapters.select(book, position, F.coalesce(F.col(chars).cast("double"), F.lit(0.0)).alias("_v")).withColumn("_cum", F.sum("_v").over(upto))
    totals = c.groupBy(book).agg(F.max("_cum").alias("_total"), F.count("*").alias("_n"))
    t = tracks.select(book, position, F.coalesce(F.col(seconds).cast("double"), F.lit(0.0)).alias("_d")).withColumns({"_all": F.sum("_d").over(every), "_parts": F.count("*").over(every)})
    share = F.when(F.col("_all") > 0, F.col("_d") / F.col("_all")).otherwise(1.0 / F.col("_parts"))
    t = t.withColumn("_share", share).withColumn("_upto", F.sum("_share").over(upto)).join(totals, book)
    t = t.withColumn("_at", F.col("_upto") * F.col("_total"))
    none = F.lit(None).cast("double")
    # chapters that end at a boundary come before it
    events = c.select(book, F.col("_cum").alias("_x"), F.lit(0).alias("_kind"), F.col(position).alias("_k"), "_cum", none.alias("_at"), none.alias("_total"), F.lit(None).cast("long").alias("_n"))
    events = events.unionByName(t.select(book, F.col("_at").alias("_x"), F.lit(1).alias("_kind"), F.col(position).alias("_k"), none.alias("_cum"), "_at", "_total", "_n"))
    w = Window.partitionBy(book).orderBy("_x", "_kind", "_k")
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    placed = events.withColumns({
        "_j": F.count("_cum").over(back), "_before": F.coalesce(F.last("_cum", True).over(back), F.lit(0.0)), "_after": F.first("_cum", True).over(on),
    }).filter("_kind = 1")
    item = F.struct(F.col("_k").alias("k"), F.col("_j").alias("j"), F.col("_before").alias("before"), F.coalesce("_after", "_total").alias("after"), F.col("_at").alias("b"))
    books = placed.groupBy(book, "_n").agg(F.array_sort(F.collect_list(item)).alias("_t"))  # one book's tracks

    def step(state: Column, x: Column) -> Column:
        s, n = state["s"], F.col("_n")
        nearer = F.when(x["before"] + x["after"] <= 2 * x["b"], x["j"] + 1).otherwise(x["j"])
        end = F.when((x["j"] >= n) | (s > x["j"]), s).when(x["before"] >= x["b"], x["j"]).when(s == x["j"], x["j"] + 1).otherwise(nearer)
        end = F.when(state["done"] + 1 >= F.size("_t"), n).otherwise(end).cast("long")
        return F.struct(F.concat(state["ends"], F.array(end)).alias("ends"), end.alias("s"), (state["done"] + 1).alias("done"))

    start = F.struct(F.array().cast("array<bigint>").alias("ends"), F.lit(0).cast("long").alias("s"), F.lit(0).alias("done"))
    rows = books.select(book, F.aggregate("_t", start, step, lambda x: x["ends"]).alias("_e")).select(book, "_e", F.posexplode("_e").alias("track", "_end"))
    first = F.coalesce(F.get("_e", F.col("track") - 1), F.lit(0))
    return rows.select(book, "track", first.cast("int").alias("first_chapter"), F.col("_end").cast("int").alias("end_chapter"))


def anchored_ranges(df: DataFrame, book: str, track: str, start: str, chapters: str) -> DataFrame:
    """Adds first_chapter and end_chapter: known starts never step back, unknown ones lie evenly between their neighbours."""
    w = Window.partitionBy(book).orderBy(track)
    upto, onwards = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col(start) <= F.col(chapters), F.col(start))
    known = F.when(F.row_number().over(w) == 1, F.coalesce(known, F.lit(0))).otherwise(known)
    out = df.withColumn("_k", known)
    out = out.withColumn("_k", F.when(F.col("_k").isNotNull(), F.max("_k").over(upto))).withColumn("_n", F.row_number().over(w))
    out = out.withColumns({
        "_left": F.last("_k", True).over(upto), "_at": F.last(F.when(F.col("_k").isNotNull(), F.col("_n")), True).over(upto),
        "_right": F.coalesce(F.first("_k", True).over(onwards), F.greatest(F.col(chapters), F.max("_k").over(Window.partitionBy(book)))),
        "_next": F.coalesce(F.first(F.when(F.col("_k").isNotNull(), F.col("_n")), True).over(onwards), F.count("*").over(Window.partitionBy(book)) + 1),
    })
    first = F.coalesce(F.col("_k"), F.col("_left") + F.expr("(_right - _left) * (_n - _at) div (_next - _at)"))
    out = out.withColumn("first_chapter", first.cast("long"))
    end = F.coalesce(F.lead("first_chapter").over(w), F.greatest(F.col(chapters), F.col("first_chapter")))
    return out.withColumn("end_chapter", end.cast("long")).drop("_k", "_n", "_left", "_at", "_right", "_next")


def title_anchors(chapters: DataFrame, tracks: DataFrame, book: str, position: str, title: str, least: float = 0.6) -> DataFrame:
    """(book, chapter, track): in track order, each track takes the best title among chapters after the last one taken.

    The first of equal scores wins. A book keeps its anchors only with two of them and half of the shorter side.
    Scores are per pair inside a book; the greedy walk is a fold over the book's own tracks.
    """
    def sides(df: DataFrame, out: str) -> DataFrame:  # pairs of letters once, before the fold
        own = df.select(book, F.col(position).alias("p"), squashed(F.col(title)).alias("t")).withColumn("g", bigrams(F.col("t")))
        return own.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("p", "t", "g"))).alias(out))

    c, t = sides(chapters, "_c"), sides(tracks, "_t")
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.array().cast("array<struct<chapter:bigint,track:bigint>>").alias("found"))

    def step(state: Column, track: Column) -> Column:
        scored = F.transform(
            F.filter(F.col("_c"), lambda x: x["p"] > state["last"]), lambda x: F.struct(dice_of(x["t"], track["t"], x["g"], track["g"]).alias("s"), (-x["p"]).cast("long").alias("p"))
        )
        best = F.array_max(F.filter(scored, lambda x: x["s"] >= least))
        pair = F.struct((-best["p"]).cast("long").alias("chapter"), track["p"].cast("long").alias("track"))
        return F.when(best.isNull(), state).otherwise(F.struct((-best["p"]).cast("long").alias("last"), F.concat(state["found"], F.array(pair)).alias("found")))

    found = c.join(t, book).select(book, F.least(F.size("_c"), F.size("_t")).alias("_n"), F.aggregate("_t", start, step, lambda s: s["found"]).alias("_f"))
    kept = found.filter((F.size("_f") >= 2) & (2 * F.size("_f") >= F.col("_n")))
    return kept.select(book, F.explode("_f").alias("_a")).select(book, "_a.chapter", "_a.track")


def squeezed(df: DataFrame, book: str, order: str, track: str) -> DataFrame:
    """Chapters without a track take the last one before them; those before the first anchor the track before it."""
    w = Window.partitionBy(book).orderBy(order)
    forward = F.last(track, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(track, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("squeezed", F.coalesce(forward, F.greatest(first - 1, F.lit(0))))


def bucket_islands(df: DataFrame, book: str, order: str, track: str, chars: str) -> DataFrame:
    """Contiguous runs of one track: (book, island, track, first, last, chapters, chars); a null track ends a run."""
    w = Window.partitionBy(book).orderBy(order)
    change = F.when(F.col(track).eqNullSafe(F.lag(track).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.filter(F.col(track).isNotNull()).groupBy(book, "island", track)
    return runs.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("chapters"), F.sum(chars).alias("chars"))


def bucket_densities(islands: DataFrame, durations: DataFrame, book: str, track: str, seconds: str) -> DataFrame:
    """Adds seconds and density (characters a second) to runs of one track; 0 where the track has no known length."""
    rows = islands.join(durations.select(book, track, seconds), [book, track], "left")
    return rows.withColumn("density", F.when(F.col(seconds) > 0, F.col("chars") / F.col(seconds)).otherwise(F.lit(0.0)))


def exact_median(df: DataFrame, value: str, out: str, bins: int = 1024) -> DataFrame:
    """One row with the median of the positive values (null without any), and no task that reads them all.

    Values are counted by their logarithms' bins (``bins`` to a doubling); only the bins that hold the middle ranks are
    then looked into, by rank.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v > 0").withColumn("bin", F.floor(F.log2("v") * bins))
    order = Window.orderBy("bin")  # one row per bin
    counts = rows.groupBy("bin").agg(F.count("*").alias("n")).withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy())})
    lower, upper = F.expr("(all + 1) div 2"), F.expr("all div 2 + 1")
    middle = counts.withColumns({"low": lower, "high": upper}).filter("upto >= low AND upto - n < high")
    inside = rows.join(F.broadcast(middle), "bin")  # two bins at most
    rank = F.col("upto") - F.col("n") + F.row_number().over(Window.partitionBy("bin").orderBy("v"))
    return inside.withColumn("rank", rank).filter("rank = low OR rank = high").agg(F.avg("v").alias(out))


def drift_flags(df: DataFrame, density: str, by: list[str] | None = None, limit: float = 0.3) -> DataFrame:
    """Adds drift: densities over ``limit`` away from the median of the positive ones (of the group, if any)."""
    positive = df.filter(F.col(density) > 0)
    if by:
        middle = positive.groupBy(*by).agg(F.median(density).alias("_m"))
        out = df.join(middle, by, "left")
    else:
        middle = exact_median(positive, density, "_m").withColumn("_one", F.lit(1))
        out = df.withColumn("_one", F.lit(1)).join(F.broadcast(middle), "_one", "left").drop("_one")  # one row
    return out.withColumn("drift", F.coalesce(F.abs(F.col(density) - F.col("_m")) / F.col("_m") > limit, F.lit(False))).drop("_m")


def places(df: DataFrame, group: str, coarse: list[Column], fine: list[Column], out: str) -> DataFrame:
    """Adds the place (from 1) of each row in its group, in the order of ``coarse`` and then ``fine`` columns.

    Rows are counted by (group, coarse); a group's bins are added up in order and only a bin's rows are sorted together,
    so ``coarse`` should tell rows apart well enough that no bin is large.
    """
    names = [f"_o{i}" for i in range(len(coarse))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(coarse, names, strict=True)])
    bins = rows.groupBy(group, *names).agg(F.count("*").alias("_in"))
    before = Window.partitionBy(group).orderBy(*[F.asc_nulls_last(n) for n in names]).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_base", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    bins = bins.select(F.col(group).alias("_g"), *[F.col(n).alias(f"_b{n}") for n in names], "_base")
    same = F.col(group).eqNullSafe(F.col("_g"))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_b{n}"))
    own = Window.partitionBy(group, *names).orderBy(*fine)
    placed = rows.withColumn("_k", F.row_number().over(own)).join(bins, same)
    return placed.withColumn(out, F.col("_base") + F.col("_k")).select(*df.columns, out)
