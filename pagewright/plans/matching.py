"""Chapters and tracks: conversations stand in for books and their turns for chapters, line items for tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators import mapping
from pagewright.operators import matching as M
from pagewright.operators import silence
from pagewright.plans.registry import query, table

TRACK_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def chapters(spark, sf):
    rows = table(spark, sf, "conversations").filter(F.col("text").rlike(r"(?U)\S"))  # all white space is no body
    rows = rows.select(F.col("conv_id").alias("book"), "turn", "role", "text", F.length("text").cast("long").alias("chars"))
    return M.numbered(rows, "book", ["turn"], "pos")


def tracks(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("book", F.col("l_orderkey"))
    return M.numbered(rows, "book", TRACK_ORDER, "pos").select("book", "pos", F.col("l_quantity").alias("seconds"), "l_partkey", "l_linenumber")


_CHAPTERS = """c AS (SELECT conv_id AS book, turn, role, text, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
    FROM conversations WHERE trim(text, ' ') <> '')"""
_TRACKS = f"""t AS (SELECT l_orderkey AS book, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(TRACK_ORDER)}) - 1 AS pos,
    l_quantity AS seconds, l_partkey, l_linenumber FROM lineitem)"""


@query(f"""WITH {_CHAPTERS}, {_TRACKS},
    b AS (SELECT book, count(*) AS chapters, sum(chars)::BIGINT AS chars, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS body_md5 FROM c GROUP BY book),
    s AS (SELECT book, sum(seconds) AS seconds FROM t GROUP BY book),
    d AS (SELECT b.*, coalesce(seconds, 0) AS seconds, CASE WHEN seconds > 0 THEN chars / seconds ELSE 0 END AS density FROM b LEFT JOIN s USING (book)),
    m AS (SELECT median(density) AS m FROM d WHERE density > 0)
    SELECT book, chapters, chars, body_md5, seconds, round(density, 6) AS density, coalesce(abs(density - m) / m > 0.3, false) AS drift FROM d, m""")
def flagship_bucket_density(spark, sf):
    """Chapters joined in order, characters per second of sound, and books that drift from the median."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")  # one book's chapters
    books = chapters(spark, sf).groupBy("book").agg(F.count("*").alias("chapters"), F.sum("chars").alias("chars"), F.md5(body).alias("body_md5"))
    time = tracks(spark, sf).groupBy("book").agg(F.sum("seconds").alias("seconds"))
    density = F.when(F.col("seconds") > 0, F.col("chars") / F.col("seconds")).otherwise(0.0)
    rows = M.drift_flags(books.join(time, "book", "left").withColumn("density", density), "density")
    return rows.select("book", "chapters", "chars", "body_md5", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.round("density", 6).alias("density"), "drift")


@query(f"""WITH {_CHAPTERS}, {_TRACKS}, n AS (SELECT book, chapters, coalesce(tracks, 0) AS tracks FROM (SELECT book, count(*) AS chapters FROM c GROUP BY book)
      LEFT JOIN (SELECT book, count(*) AS tracks FROM t GROUP BY book) USING (book)),
    k AS (SELECT *, CASE WHEN chapters = 0 OR tracks = 0 THEN 'unalignable' WHEN chapters = tracks THEN NULL WHEN chapters = 1 AND tracks >= 3 THEN 'one_to_many'
      WHEN tracks = 1 AND chapters >= 3 THEN 'many_to_one' WHEN abs(chapters - tracks) <= 2 THEN 'count_off'
      WHEN chapters > tracks AND tracks >= 2 AND 2 * chapters > 3 * tracks AND chapters <= 30 * tracks THEN 'many_to_few'
      WHEN greatest(chapters, tracks) > 3 * least(chapters, tracks) THEN 'unalignable' ELSE 'count_off' END AS condition FROM n)
    SELECT *, CASE condition WHEN 'count_off' THEN 'pair_accept,pair_drop,cancel' WHEN 'many_to_few' THEN 'split_proportional,single_lesson,cancel'
      WHEN NULL THEN NULL ELSE CASE WHEN condition IS NULL THEN NULL ELSE 'single_lesson,cancel' END END AS options,
      CASE condition WHEN 'count_off' THEN 'pair_accept' WHEN 'many_to_few' THEN 'split_proportional' WHEN 'unalignable' THEN 'cancel'
      ELSE CASE WHEN condition IS NULL THEN NULL ELSE 'single_lesson' END END AS preselect FROM k""")
def a1_count_classify(spark, sf):
    """Mismatch condition of each book's counts, allowed responses and the one chosen beforehand."""
    c = chapters(spark, sf).groupBy("book").agg(F.count("*").alias("chapters"))
    t = tracks(spark, sf).groupBy("book").agg(F.count("*").alias("tracks"))
    both = c.join(t, "book", "left").fillna(0, ["tracks"]).withColumn("condition", M.count_class(F.col("chapters"), F.col("tracks")))
    return M.allowed_responses(both).withColumn("options", F.array_join("options", ",")).select("book", "chapters", "tracks", "condition", "options", "preselect")


@query(f"""WITH {_CHAPTERS}, {_TRACKS}, same AS (SELECT book FROM (SELECT book, count(*) AS n FROM c GROUP BY book) JOIN (SELECT book, count(*) AS n FROM t GROUP BY book) USING (book, n))
    SELECT book, pos, turn, l_partkey, seconds FROM c JOIN t USING (book, pos) WHERE book IN (SELECT book FROM same)""")
def j1_positional_pairs(spark, sf):
    return M.positional_pairs(chapters(spark, sf), tracks(spark, sf), "book").select("book", "pos", "turn", "l_partkey", "seconds")


@query(f"WITH {_CHAPTERS}, {_TRACKS} SELECT book, pos, turn, l_partkey FROM c LEFT JOIN t USING (book, pos)")
def j2_index_pairs(spark, sf):
    return M.positional_pairs(chapters(spark, sf), tracks(spark, sf), "book", equal_only=False).select("book", "pos", "turn", "l_partkey")


@query(f"""WITH RECURSIVE {_CHAPTERS}, {_TRACKS},
    cum AS (SELECT book, list(s ORDER BY pos) AS cum, max(s) AS total, count(*) AS n FROM (SELECT book, pos, sum(chars) OVER (PARTITION BY book ORDER BY pos) AS s FROM c) GROUP BY book),
    share AS (SELECT book, pos, seconds / sum(seconds) OVER (PARTITION BY book) AS share, count(*) OVER (PARTITION BY book) AS parts FROM t),
    walk AS (SELECT book, -1::BIGINT AS track, 0::DOUBLE AS upto, 0::BIGINT AS first_chapter, 0::BIGINT AS end_chapter FROM cum
      UNION ALL
      SELECT book, track, upto, s, CASE WHEN track + 1 >= parts THEN n WHEN j >= n OR s > j THEN s WHEN prev >= b THEN j WHEN s = j THEN j + 1
        WHEN prev + coalesce(cum[j + 1], total) <= 2 * b THEN j + 1 ELSE j END
      FROM (SELECT *, CASE WHEN j > 0 THEN cum[j] ELSE 0 END AS prev FROM (SELECT w.book, w.track + 1 AS track, w.upto + h.share AS upto, (w.upto + h.share) * q.total AS b,
        len(list_filter(q.cum, lambda x: x <= (w.upto + h.share) * q.total)) AS j, w.end_chapter AS s, h.parts, q.n, q.cum, q.total
        FROM walk w JOIN share h ON h.book = w.book AND h.pos = w.track + 1 JOIN cum q ON q.book = w.book)))
    SELECT book, track::INT AS track, first_chapter::INT AS first_chapter, end_chapter::INT AS end_chapter FROM walk WHERE track >= 0""")
def w5_proportional_pack(spark, sf):
    """Chapters packed onto tracks by shares of time and characters."""
    return M.proportional_pack(chapters(spark, sf), tracks(spark, sf), "book", "pos", "chars", "seconds")


_ANCHORS = f"""{_TRACKS}, a AS (SELECT book, pos, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 12 END AS start, 8 AS chapters FROM t)"""


def anchors(spark, sf):
    start = F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 12)
    return tracks(spark, sf).select("book", "pos", start.alias("start"), F.lit(8).cast("long").alias("chapters"))


@query(f"""WITH {_ANCHORS}, k AS (SELECT *, row_number() OVER w AS n, CASE WHEN row_number() OVER w = 1 THEN coalesce(CASE WHEN start <= chapters THEN start END, 0)
      WHEN start <= chapters THEN start END AS k0 FROM a WINDOW w AS (PARTITION BY book ORDER BY pos)),
    m AS (SELECT *, CASE WHEN k0 IS NOT NULL THEN max(k0) OVER (PARTITION BY book ORDER BY pos) END AS k FROM k),
    l AS (SELECT *, last_value(k IGNORE NULLS) OVER w AS lft, last_value(CASE WHEN k IS NOT NULL THEN n END IGNORE NULLS) OVER w AS here,
      coalesce(first_value(k IGNORE NULLS) OVER x, 8) AS rgt, coalesce(first_value(CASE WHEN k IS NOT NULL THEN n END IGNORE NULLS) OVER x, count(*) OVER (PARTITION BY book) + 1) AS nxt
      FROM m WINDOW w AS (PARTITION BY book ORDER BY pos ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY book ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    f AS (SELECT book, pos, coalesce(k, lft + (rgt - lft) * (n - here) // (nxt - here)) AS first_chapter FROM l)
    SELECT book, pos, first_chapter, coalesce(lead(first_chapter) OVER (PARTITION BY book ORDER BY pos), 8)::BIGINT AS end_chapter FROM f""")
def w6_anchored_ranges(spark, sf):
    """Chapter ranges of tracks from partly known starts."""
    return M.anchored_ranges(anchors(spark, sf), "book", "pos", "start", "chapters").select("book", "pos", "first_chapter", "end_chapter")


@query(f"""WITH {_ANCHORS} SELECT book, pos, start FROM (SELECT *, max(start) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a)
    WHERE start IS NOT NULL AND (before IS NULL OR start > before)""")
def w8_increasing_starts(spark, sf):
    """Starts that lie after all starts before them."""
    before = F.max("start").over(Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = anchors(spark, sf).withColumn("before", before)
    return rows.filter(F.col("start").isNotNull() & (F.col("before").isNull() | (F.col("start") > F.col("before")))).select("book", "pos", "start")


@query(f"""WITH {_TRACKS}, s AS (SELECT *, sum(seconds) OVER w AS end_at FROM t WINDOW w AS (PARTITION BY book ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT book, pos, end_at - seconds AS start_at, coalesce(lead(end_at - seconds) OVER (PARTITION BY book ORDER BY pos), end_at) AS next_start FROM s""")
def w9_w11_track_times(spark, sf):
    """Running start of every track, and where the next one starts."""
    w = Window.partitionBy("book").orderBy("pos")
    rows = tracks(spark, sf).withColumn("end_at", F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("end_at") - F.col("seconds")
    return rows.withColumn("start_at", start).select("book", "pos", "start_at", F.coalesce(F.lead("start_at").over(w), "end_at").alias("next_start"))


@query(f"""WITH {_TRACKS} SELECT book, pos, seconds FROM (SELECT *, greatest(6.0, sum(seconds) OVER (PARTITION BY book) / count(*) OVER (PARTITION BY book) / 10) AS least FROM t)
    WHERE seconds >= least""")
def f7_atom_filter(spark, sf):
    """Tracks of at least six seconds and a tenth of the book's mean."""
    w = Window.partitionBy("book")
    least = F.greatest(F.lit(6.0), F.sum("seconds").over(w) / F.count("*").over(w) / 10)
    return tracks(spark, sf).withColumn("least", least).filter(F.col("seconds") >= F.col("least")).select("book", "pos", "seconds")


_ISLANDS = """e AS (SELECT user_id AS book, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS track, CAST(round(value * 100) AS BIGINT) AS chars FROM events),
    g AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND track IS NOT DISTINCT FROM lag(track) OVER w THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY book ORDER BY event_id)),
    i AS (SELECT *, sum(c) OVER (PARTITION BY book ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)"""


@query(f"""WITH {_ISLANDS} SELECT book, island::BIGINT AS island, track, min(event_id) AS first, max(event_id) AS last, count(*) AS chapters, sum(chars)::BIGINT AS chars
    FROM i WHERE track IS NOT NULL GROUP BY ALL""")
def w7_bucket_islands(spark, sf):
    """Contiguous runs of one track; a chapter without a track ends a run."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("book"), "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("track"), F.round(F.col("value") * 100).cast("long").alias("chars")
    )
    return M.bucket_islands(rows, "book", "event_id", "track", "chars")


@query(f"""WITH {_ISLANDS}, r AS (SELECT book, island::BIGINT AS island, track, sum(chars)::BIGINT AS chars FROM i WHERE track IS NOT NULL GROUP BY ALL),
    d AS (SELECT user_id AS book, event_type AS track, CASE WHEN user_id % 4 > 0 THEN count(*) * (user_id % 3) ELSE NULL END AS seconds FROM events GROUP BY user_id, event_type)
    SELECT book, island, track, chars, round(CASE WHEN seconds > 0 THEN chars / seconds ELSE 0 END, 9) AS density FROM r LEFT JOIN d USING (book, track)""")
def a3_bucket_densities(spark, sf):
    """Characters a second of every run of one track."""
    e = table(spark, sf, "events")
    seconds = e.groupBy(F.col("user_id").alias("book"), F.col("event_type").alias("track")).agg(F.when(F.col("user_id") % 4 > 0, F.count("*") * (F.col("user_id") % 3)).alias("seconds"))
    runs = w7_bucket_islands(spark, sf)
    return M.bucket_densities(runs, seconds, "book", "track", "seconds").select("book", "island", "track", "chars", F.round("density", 9).alias("density"))


@query("""WITH e AS (SELECT user_id AS book, event_id, CASE WHEN event_type = 'signup' THEN event_id % 7 END AS track FROM events)
    SELECT book, event_id, track, coalesce(last_value(track IGNORE NULLS) OVER (PARTITION BY book ORDER BY event_id ROWS UNBOUNDED PRECEDING),
      greatest(first_value(track IGNORE NULLS) OVER (PARTITION BY book ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1, 0)) AS squeezed FROM e""")
def j4_squeeze(spark, sf):
    """Chapters between anchors take the track before them."""
    track = F.when(F.col("event_type") == "signup", F.col("event_id") % 7)
    rows = table(spark, sf, "events").select(F.col("user_id").alias("book"), "event_id", track.alias("track"))
    return M.squeezed(rows, "book", "event_id", "track")


_QUIET = """s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value FROM events),
    w AS (SELECT user_id, pos // 3 AS win, sqrt(avg(value * value)) AS rms FROM s GROUP BY ALL),
    q AS (SELECT user_id, win, win - row_number() OVER (PARTITION BY user_id ORDER BY win) AS g FROM w WHERE rms <= 60),
    r AS (SELECT user_id, min(win) AS first_win, max(win) AS last_win, count(*) AS windows FROM q GROUP BY user_id, g HAVING count(*) >= 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_win) AS run FROM r)"""


def quiet_runs(spark, sf):
    rows = M.numbered(table(spark, sf, "events"), "user_id", ["event_id"], "pos")
    return silence.silence_runs(silence.windows(rows, "user_id", "pos", "value", 3), "user_id", 60.0, 2)


@query(f"WITH {_QUIET} SELECT user_id, run, first_win, last_win, windows FROM n")
def w1_silence_runs(spark, sf):
    """Islands of quiet windows in each stream of values."""
    return quiet_runs(spark, sf).select("user_id", "run", "first_win", "last_win", "windows")


@query(f"""WITH {_QUIET} SELECT user_id, run, first_win AS cut_at, 'drop_start' AS kind FROM n UNION ALL SELECT user_id, run, last_win + 1, 'drop_end' FROM n""")
def w2_boundaries(spark, sf):
    """Both ends of every quiet run."""
    rows = quiet_runs(spark, sf).withColumn("end", F.col("last_win") + 1)
    return silence.boundaries(rows, "first_win", "end", "drop").select("user_id", "run", "cut_at", "kind")


@query(f"""WITH {_QUIET} SELECT 'forward' AS policy, user_id, run, last_win + 1 AS cut_at, 'cut' AS kind FROM n UNION ALL SELECT 'backward', user_id, run, first_win, 'cut' FROM n
    UNION ALL SELECT 'drop', user_id, run, first_win, 'drop_start' FROM n UNION ALL SELECT 'drop', user_id, run, last_win + 1, 'drop_end' FROM n""")
def w2_all_policies(spark, sf):
    """Cuts by each policy: at the end of a quiet run, at its start, or at both."""
    rows = quiet_runs(spark, sf).withColumn("end", F.col("last_win") + 1)
    each = [silence.boundaries(rows, "first_win", "end", p).select(F.lit(p).alias("policy"), "user_id", "run", "cut_at", "kind") for p in ("forward", "backward", "drop")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"""WITH {_CHAPTERS}, h AS (SELECT *, role = 'user' AS hit FROM c), g AS (SELECT *, sum(hit::INT) OVER (PARTITION BY book ORDER BY turn ROWS UNBOUNDED PRECEDING) AS gid FROM h),
    k AS (SELECT *, CASE WHEN gid = 0 THEN pos ELSE -1 END AS sub FROM g)
    SELECT book, row_number() OVER (PARTITION BY book ORDER BY min(turn)) - 1 AS chapter, min(turn) AS first_turn, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS body_md5
    FROM k GROUP BY book, gid, sub""")
def w3_w4_toc_folding(spark, sf):
    """Rows without a heading join the row before that has one; leading ones stay apart; then a new numbering."""
    w = Window.partitionBy("book").orderBy("turn")
    rows = chapters(spark, sf).withColumn("gid", F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("sub", F.when(F.col("gid") == 0, F.col("pos")).otherwise(-1))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    folded = rows.groupBy("book", "gid", "sub").agg(F.min("turn").alias("first_turn"), F.md5(body).alias("body_md5"))
    return M.numbered(folded, "book", ["first_turn"], "chapter").select("book", "chapter", "first_turn", "body_md5")


@query(f"""WITH {_CHAPTERS}, b AS (SELECT book, min(turn) FILTER (role = 'assistant') AS lo, max(turn) FILTER (role = 'assistant') AS hi FROM c GROUP BY book)
    SELECT book, turn, chars FROM c JOIN b USING (book) WHERE turn BETWEEN lo AND hi""")
def f6_bounded_slice(spark, sf):
    """The chapters between two boundary chapters, both included."""
    rows = chapters(spark, sf)
    only = F.when(F.col("role") == "assistant", F.col("turn"))
    ends = rows.groupBy("book").agg(F.min(only).alias("lo"), F.max(only).alias("hi"))
    return rows.join(ends, "book").filter("turn BETWEEN lo AND hi").select("book", "turn", "chars")


@query("""WITH c AS (SELECT conv_id AS book, turn, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE turn END AS id FROM conversations),
    n AS (SELECT book, id, count(*) AS n, min(turn) AS at FROM c GROUP BY ALL), r AS (SELECT DISTINCT conv_id + (conv_id % 11 = 0)::INT * 1000000000 AS book, conv_id % 3 AS s, conv_id % 4 AS e FROM conversations)
    SELECT r.book, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.book = r.book) THEN 'empty' WHEN a.n IS NULL THEN 'missing start' WHEN a.n > 1 THEN 'duplicate start' WHEN z.n IS NULL THEN 'missing end'
      WHEN z.n > 1 THEN 'duplicate end' WHEN z.at < a.at THEN 'reversed' END AS error FROM r LEFT JOIN n a ON a.book = r.book AND a.id = s LEFT JOIN n z ON z.book = r.book AND z.id = e""")
def f6_slice_errors(spark, sf):
    """Why a range of chapters cannot be taken: no chapters, boundaries that are missing or doubled, an end before the start."""
    c = table(spark, sf, "conversations").withColumn("book", F.col("conv_id"))
    chapters = c.select("book", "turn", F.when(F.col("book") % 7 == 0, 0).otherwise(F.col("turn")).alias("id"))
    shifted = F.col("book") + F.when(F.col("book") % 11 == 0, 1_000_000_000).otherwise(0)
    ranges = c.select("book").distinct().select(shifted.alias("book"), (F.col("book") % 3).alias("start"), (F.col("book") % 4).alias("end"))
    return mapping.bounded_slice(chapters, ranges, "book", "id", "turn")[1].select("book", "error")


@query(f"""WITH {_CHAPTERS}, {_TRACKS}, k AS (SELECT book, pos, turn, l_partkey, 'paired' AS step FROM c JOIN t USING (book, pos)),
    base AS (SELECT book, max(pos) + 1 AS base FROM c GROUP BY book),
    rest AS (SELECT book, pos, l_partkey FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.book = t.book AND c.pos = t.pos) AND book IN (SELECT book FROM c))
    SELECT book, pos AS chapter_index, l_partkey, step FROM k
    UNION ALL SELECT book, base + row_number() OVER (PARTITION BY book ORDER BY pos) - 1, l_partkey, 'audio_only' FROM rest JOIN base USING (book)""")
def u2_j21_plan_with_leftovers(spark, sf):
    """Paired steps, then one for each track that no chapter has, numbered after the chapters."""
    c, t = chapters(spark, sf), tracks(spark, sf)
    paired = c.select("book", "pos").join(t, ["book", "pos"]).select("book", F.col("pos").alias("chapter_index"), "l_partkey", F.lit("paired").alias("step"))
    base = c.groupBy("book").agg((F.max("pos") + 1).alias("base"))
    rest = M.numbered(t.join(c, ["book", "pos"], "left_anti").join(base, "book"), "book", ["pos"], "k")
    return paired.unionByName(rest.select("book", (F.col("base") + F.col("k")).alias("chapter_index"), "l_partkey", F.lit("audio_only").alias("step")))


@query(None)
def j3_title_anchors(spark, sf):
    """Greedy, monotone title matches of two orders of one brand's parts (no SQL twin: a fold with scores)."""
    part = table(spark, sf, "part").select(F.col("p_brand").alias("book"), "p_partkey", F.col("p_name").alias("title"), "p_size")
    c = M.numbered(part.dropDuplicates(["book", "title"]), "book", ["title"], "pos")
    t = M.numbered(part.filter("p_size > 25").dropDuplicates(["book", "title"]), "book", ["title"], "pos")
    return M.title_anchors(c, t, "book", "pos", "title")
