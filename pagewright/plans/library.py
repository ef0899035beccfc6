"""The library: customers stand in for projects, their orders for receipts, documents and labels for lessons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import identity
from pagewright.operators import course
from pagewright.operators import library as L
from pagewright.operators import matching as M
from pagewright.plans.registry import query, table

ACTIVITY = ["o_orderdate", "o_orderkey"]


def projects(spark, sf):
    """One row per project with its receipts summed up."""
    o = table(spark, sf, "orders")
    last = F.max_by(F.struct((F.col("o_orderstatus") == "F").alias("bad"), F.col("o_orderdate").alias("at")), F.struct(*ACTIVITY)).alias("_l")
    receipts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("receipts"), F.count_if(F.col("o_orderstatus") != "P").alias("cursor"), F.count_if(F.col("o_orderstatus") == "F").alias("unfinished"), last
    )
    rows = table(spark, sf, "customer").join(receipts, "c_custkey", "left").fillna(0, ["receipts", "cursor", "unfinished"])
    total = F.when(F.col("c_nationkey") % 2 == 0, F.col("receipts")).otherwise(F.col("receipts") + 1)
    return rows.select(
        F.col("c_custkey").alias("project"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"), "receipts", "cursor", "unfinished",
        (F.col("c_acctbal") > 9000).alias("running"), (F.col("c_acctbal") > 0).alias("confirmed"), total.alias("total"),
        F.col("_l.bad").alias("last_bad"), F.col("_l.at").alias("activity"),
    )


_PROJECTS = """r AS (SELECT o_custkey, count(*) AS receipts, count(*) FILTER (o_orderstatus <> 'P') AS cursor, count(*) FILTER (o_orderstatus = 'F') AS unfinished,
      arg_max(o_orderstatus = 'F', (o_orderdate, o_orderkey)) AS last_bad, max(o_orderdate) AS activity FROM orders GROUP BY o_custkey),
    p AS (SELECT c_custkey AS project, c_name AS title, c_mktsegment AS segment, coalesce(receipts, 0) AS receipts, coalesce(cursor, 0) AS cursor, coalesce(unfinished, 0) AS unfinished,
      c_acctbal > 9000 AS running, c_acctbal > 0 AS confirmed, coalesce(receipts, 0) + CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE 1 END AS total, last_bad, activity
      FROM customer LEFT JOIN r ON c_custkey = o_custkey),
    s AS (SELECT *, CASE WHEN running THEN 'running' WHEN NOT confirmed AND receipts = 0 THEN 'needs_match' WHEN coalesce(last_bad, false) AND cursor < total THEN 'failed'
      WHEN total > 0 AND cursor >= total AND NOT coalesce(last_bad, false) THEN 'done' WHEN receipts > 0 AND cursor < total THEN 'paused' ELSE 'idle' END AS status FROM p)"""


def with_status(spark, sf):
    c = F.col
    return projects(spark, sf).withColumn("status", L.status(c("running"), c("confirmed"), c("receipts"), c("cursor"), c("total"), c("last_bad")))


@query(f"WITH {_PROJECTS} SELECT project, title, receipts, cursor, total, coalesce(last_bad, false) AS last_bad, status FROM s")
def p9_library_status(spark, sf):
    """Summary projection and derived status of every project."""
    return with_status(spark, sf).select("project", "title", "receipts", "cursor", "total", F.coalesce("last_bad", F.lit(False)).alias("last_bad"), "status")


_SHOWN = "['running', 'needs_match', 'paused', 'done', 'failed', 'idle']"


@query(f"""WITH {_PROJECTS} SELECT segment, project, row_number() OVER (PARTITION BY segment ORDER BY list_position({_SHOWN}, status),
      CASE WHEN status = 'done' THEN activity END DESC NULLS LAST, title) AS place FROM s""")
def o1_library_order(spark, sf):
    """Place of each project in its shelf: status, latest activity of what is done, title."""
    rank = F.array_position(F.array(*[F.lit(x) for x in L.STATUS_ORDER]), F.col("status"))
    order = L.library_order(rank, F.col("activity"), F.col("title"), F.col("status") == "done")
    latest = -F.unix_seconds(F.date_trunc("day", F.when(F.col("status") == "done", F.col("activity"))))
    return M.places(with_status(spark, sf), "segment", [rank, latest, F.left("title", F.lit(14))], order, "place").select("segment", "project", "place")


@query("""WITH t AS (SELECT c_custkey, c_mktsegment AS segment, ['é', 'E', 'e', 'É', 'z', 'Zo', 'zo', 'ñ', 'n', '_', '9'][1 + c_custkey % 11] || CASE WHEN c_custkey % 3 = 0 THEN ' A' ELSE 'a' END || c_custkey % 101 AS title FROM customer)
    SELECT segment, c_custkey, title, row_number() OVER (PARTITION BY segment ORDER BY icu_sort_key(title, 'en'), c_custkey) AS place FROM t""")
def o1_localised_titles(spark, sf):
    """Titles as readers sort them: letters before accents before case."""
    key = F.col("c_custkey")
    first = F.get(F.array(*[F.lit(x) for x in ("é", "E", "e", "É", "z", "Zo", "zo", "ñ", "n", "_", "9")]), (key % 11).cast("int"))
    title = F.concat(first, F.when(key % 3 == 0, " A").otherwise("a"), (key % 101).cast("string"))
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), title.alias("title"))
    return M.places(rows, "segment", [L.title_bins(rows, "title")], [L.localised(F.col("title")), F.col("c_custkey")], "place")


@query(f"""WITH {_PROJECTS}, l AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) % 40 AS chapter FROM orders GROUP BY o_custkey)
    SELECT project, status, CASE WHEN status = 'failed' THEN 'stopped at chapter ' || chapter END AS reason FROM s LEFT JOIN l ON o_custkey = project""")
def p9_status_reasons(spark, sf):
    """Why a project is where it is."""
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project")).agg((F.max_by("o_orderkey", F.struct(*ACTIVITY)) % 40).alias("chapter"))
    return with_status(spark, sf).join(last, "project", "left").select("project", "status", L.status_reason(F.col("status"), F.col("chapter")).alias("reason"))


@query(f"WITH {_PROJECTS} SELECT project FROM s WHERE unfinished > 0 OR cursor < receipts OR (receipts = 0 AND confirmed)")
def f12_pending_queue(spark, sf):
    """Projects whose job is to be resumed."""
    c = F.col
    return projects(spark, sf).filter(L.is_pending(c("receipts"), c("unfinished"), c("cursor"), F.lit(0), c("confirmed"))).select("project")


@query(f"WITH {_PROJECTS} SELECT segment, count(*) AS projects, count(*) FILTER (running) AS running, array_to_string(list_sort(list_distinct(list(status))), ',') AS statuses FROM s GROUP BY segment")
def a8_library_counts(spark, sf):
    return with_status(spark, sf).groupBy("segment").agg(
        F.count("*").alias("projects"), F.count_if("running").alias("running"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses")
    )


@query(f"""WITH {_PROJECTS} SELECT segment, status AS class, count(*) AS n, max(activity) AS last_activity, grouping(segment) = 1 AS all_segments
    FROM s GROUP BY GROUPING SETS ((segment, status), (status))""")
def a17_health_counts(spark, sf):
    """Projects by status with their last activity, in each shelf and over all."""
    rows = with_status(spark, sf).withColumnRenamed("status", "class")
    counts = rows.groupingSets([["segment", "class"], ["class"]], "segment", "class").agg(
        F.count("*").alias("n"), F.max("activity").alias("last_activity"), (F.grouping("segment") == 1).alias("all_segments")
    )
    return counts.select("segment", "class", "n", "last_activity", "all_segments")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1""")
def w14_freshest(spark, sf):
    """The freshest row of every key."""
    return L.freshest(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_receipt, min(o_orderkey) FILTER (o_orderstatus <> 'F') AS first_not_done,
      count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey""")
def w15_w16_a11_receipts(spark, sf):
    """Last receipt, first row that is not done, and rows that are."""
    order = F.struct(*ACTIVITY)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", order).alias("last_receipt"), F.min(F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))).alias("first_not_done"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
    )


@query("""WITH k AS (SELECT o_custkey, o_orderkey, o_orderpriority, lag(o_orderpriority) OVER w AS prev, lead(o_orderpriority) OVER w AS nxt FROM orders
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_custkey, o_orderkey, coalesce(prev = o_orderpriority, false) AS joins_previous, coalesce(nxt = o_orderpriority, false) AS joins_next FROM k""")
def w13_series_connectors(spark, sf):
    """Rows of the same series as their neighbours."""
    w = Window.partitionBy("o_custkey").orderBy(*ACTIVITY)
    same = lambda c: F.coalesce(c.over(w) == F.col("o_orderpriority"), F.lit(False))
    return table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", same(F.lag("o_orderpriority")).alias("joins_previous"), same(F.lead("o_orderpriority")).alias("joins_next")
    )


@query("""WITH k AS (SELECT *, o_orderstatus = 'P' AS skipped FROM orders)
    SELECT o_custkey, o_orderkey, coalesce(min(CASE WHEN NOT skipped THEN (o_orderdate, o_orderkey) END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
      max(CASE WHEN NOT skipped THEN (o_orderdate, o_orderkey) END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))[2] AS neighbour
    FROM k WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def w17_kept_neighbours(spark, sf):
    """The nearest row after each one that is not skipped, else the nearest before."""
    w = Window.partitionBy("o_custkey").orderBy(*ACTIVITY)
    kept = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey"))
    after = F.first(kept, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.coalesce(after, F.last(kept, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("neighbour"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3""")
def o3_top_three(spark, sf):
    """The three best of each group, the first among equals."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS parts FROM lineitem GROUP BY l_orderkey""")
def o7_canonical_selection(spark, sf):
    """Sorted distinct ids of each selection."""
    ids = F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(ids, ",").alias("parts"))


@query("""WITH k AS (SELECT l_orderkey, l_partkey, min((l_linenumber, l_suppkey)) AS p FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_partkey) AS place FROM k""")
def u3_ordered_append(spark, sf):
    """First occurrences in order: what is there already is not appended again."""
    first = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min(F.struct("l_linenumber", "l_suppkey")).alias("p"))
    return first.select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("p", "l_partkey")).cast("long").alias("place"))


@query("""SELECT o_orderkey, l_partkey IS NOT NULL AS uploaded, l_partkey FROM orders LEFT JOIN
      (SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def j18_plan_receipts(spark, sf):
    """Plan steps with their last receipt, if any."""
    last = F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("l_partkey")
    receipts = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(last)
    return table(spark, sf, "orders").join(receipts, "o_orderkey", "left").select("o_orderkey", F.col("l_partkey").isNotNull().alias("uploaded"), "l_partkey")


@query("""SELECT coalesce(c_custkey, o_custkey) AS track, count(o_orderkey) AS chapters, c_custkey IS NULL AS unpaired FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON c_custkey = o_custkey GROUP BY ALL""")
def j20_bands(spark, sf):
    """Bands of chapters by track; known tracks stay when they are empty."""
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey")
    rows = table(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "full")
    return rows.groupBy(F.coalesce("c_custkey", "o_custkey").alias("track"), F.col("c_custkey").isNull().alias("unpaired")).agg(F.count("o_orderkey").alias("chapters"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def j21_unclaimed_tracks(spark, sf):
    """Tracks that are neither used nor claimed nor parked."""
    c = table(spark, sf, "customer").select("c_custkey")
    used = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(used, "c_custkey", "left_anti").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT s_nationkey, s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def j10_lookup(spark, sf):
    """Titles looked up by path in a small table."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")  # planned by its size
    return table(spark, sf, "supplier").join(n, "s_nationkey", "left").select("s_nationkey", "s_suppkey", "n_name")


@query("""SELECT 'customer' AS origin, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
    UNION ALL SELECT 'supplier', n_name, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def u1_union_sources(spark, sf):
    """Candidates of all sources, each with its origin."""
    n = table(spark, sf, "nation")
    parts = [("customer", "c_nationkey"), ("supplier", "s_nationkey")]
    rows = [table(spark, sf, t).select(F.lit(t).alias("origin"), F.col(k).alias("n_nationkey")) for t, k in parts]
    return rows[0].unionByName(rows[1]).join(n, "n_nationkey").groupBy("origin", "n_name").agg(F.count("*").alias("n"))


_LESSONS = "x AS (SELECT source AS course, CASE WHEN n_chars > 200 THEN n_chars END AS words, quality * 100 AS pct, n_chars / 10 AS duration FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"""WITH {_LESSONS}, m AS (SELECT course, coalesce(avg(words), 1) AS mean FROM x GROUP BY course)
    SELECT course, count(*) AS lessons, sum(words)::BIGINT AS total_words, round(sum(duration), 3) AS total_duration, count(*) FILTER (pct >= 100) AS lessons_read,
      floor(sum(CASE WHEN pct IS NOT NULL THEN coalesce(words, mean) END * pct) / sum(CASE WHEN pct IS NOT NULL THEN coalesce(words, mean) END) + 0.5)::BIGINT AS progress
    FROM x JOIN m USING (course) GROUP BY course""")
def a5_a7_course_stats(spark, sf):
    """Totals and word-weighted progress of every course."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("source").alias("course"), F.when(F.col("n_chars") > 200, F.col("n_chars")).alias("words"), (F.col("quality") * 100).alias("pct"), (F.col("n_chars") / 10).alias("duration")
    )
    return course.course_stats(rows, "course", "words", "pct", "duration").withColumn("total_duration", F.round("total_duration", 3))


@query(f"""WITH {_LESSONS}, m AS (SELECT course, coalesce(avg(words), 1) AS mean FROM x GROUP BY course),
    g AS (SELECT course, count(*) AS lessons, sum(words)::BIGINT AS total_words FROM x JOIN m USING (course) GROUP BY course),
    h AS (SELECT course, CASE WHEN lessons % 2 = 0 THEN lessons * 1000 END AS total_words FROM g)
    SELECT d.doc_id, d.source AS course, g.lessons, coalesce(h.total_words, g.total_words)::BIGINT AS course_words, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS lesson
    FROM documents d JOIN g ON d.source = g.course JOIN h ON h.course = g.course""")
def a6_p15_course_view(spark, sf):
    """Lessons under their course's header, whose own total goes before the sum."""
    d = table(spark, sf, "documents").withColumnRenamed("source", "course")
    lessons = d.select("course", F.when(F.col("n_chars") > 200, F.col("n_chars")).alias("words"), F.lit(None).cast("double").alias("pct"), F.lit(0.0).alias("duration"))
    stats = course.course_stats(lessons, "course", "words", "pct", "duration").select("course", "lessons", "total_words")
    header = stats.select("course", F.when(F.col("lessons") % 2 == 0, F.col("lessons") * 1000).alias("total_words"))
    view = course.with_header(stats, header, "course", ["total_words"]).withColumnRenamed("total_words", "course_words")
    place = M.places(d.select("doc_id", "course"), "course", [F.expr("doc_id div 1000")], ["doc_id"], "lesson")
    return place.join(view, "course").select("doc_id", "course", "lessons", "course_words", "lesson")


@query("""SELECT o_orderpriority AS band, round(avg(least(1, greatest(0, o_totalprice / 400000))), 9) AS mean_confidence,
      round(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 250000)::DOUBLE / nullif(count(*) FILTER (o_totalprice > 250000), 0), 9) AS accept_precision FROM orders GROUP BY 1""")
def a15_a16_calibration(spark, sf):
    """Mean clamped confidence, and the precision of what is accepted."""
    p, sure = F.col("o_totalprice"), F.col("o_totalprice") > 250000
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("band")).agg(
        F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p / 400000))), 9).alias("mean_confidence"),
        F.round(F.count_if(sure & (F.col("o_orderstatus") == "F")) / F.nullif(F.count_if(sure), F.lit(0)), 9).alias("accept_precision"),
    )


@query(None)
def p10_candidate_groups(spark, sf):
    """Candidates grouped with the first head that shares a key (no SQL twin: order decides)."""
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"), F.concat("p_brand", F.lit("/"), "p_name").alias("strong"), F.concat_ws("/", "p_name", F.col("p_size").cast("string")).alias("content"), "p_name"
    )
    return L.candidate_groups(rows, "p_name", "position", ["strong", "content"])


@query(None)
def p10_reconcile_chain(spark, sf):
    """Candidates of two shelves grouped by shared keys, then merged, in conflict or created (no SQL twin: order decides)."""
    title = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    parts = table(spark, sf, "part").select("p_partkey", title.alias("title"), "p_name", F.when(F.col("p_partkey") % 3 > 0, F.concat_ws("/", F.lit("isbn"), "p_name", "p_size")).alias("strong"))
    parts = parts.withColumn("content", F.concat(F.lit("ch:"), identity.content_hash(F.col("title"), F.lit(""))))
    candidates = parts.select(F.col("p_partkey").alias("position"), "title", "p_name", "strong", "content")
    kept = parts.filter("p_partkey % 7 = 0").groupBy(F.coalesce("strong", "content").alias("key")).agg(F.min_by("title", "p_partkey").alias("title"), F.min("p_partkey").alias("pos"))
    return L.reconcile(candidates, kept, "p_name", ["strong", "content"])


_ASKED = """e AS (SELECT 'k:' || n_name || repeat(' (copy)', (n_nationkey % 3)::INT) AS key, n_name || repeat(' (copy)', (n_nationkey % 3)::INT) AS title FROM nation WHERE n_nationkey % 4 > 0
      UNION SELECT 'k:' || n_name, n_name FROM nation WHERE n_nationkey % 2 = 0),
    a AS (SELECT c_custkey AS seq, n_name AS title, [NULL, 'replace', 'skip', 'new'][1 + c_custkey % 4] AS resolution FROM customer JOIN nation ON c_nationkey = n_nationkey),
    f AS (SELECT title, min(k) AS k FROM (SELECT DISTINCT title FROM a), (SELECT unnest(range(1, 101)) AS k) WHERE 'k:' || title || repeat(' (copy)', k::INT) NOT IN (SELECT key FROM e) GROUP BY title)"""


@query(f"""WITH {_ASKED} SELECT seq, a.title, resolution, CASE WHEN e.key IS NULL THEN 'created' ELSE coalesce(['replaced', 'skipped', 'created'][list_position(['replace', 'skip', 'new'], resolution)], 'conflict') END AS outcome,
      CASE WHEN e.key IS NOT NULL AND resolution = 'new' THEN 'k:' || a.title || repeat(' (copy)', k::INT) ELSE 'k:' || a.title END AS project,
      CASE WHEN e.key IS NOT NULL AND resolution = 'new' THEN a.title || repeat(' (copy)', k::INT) ELSE a.title END AS shown FROM a LEFT JOIN e ON e.key = 'k:' || a.title LEFT JOIN f ON f.title = a.title""")
def p14_creations(spark, sf):
    """New projects whose key is free or taken, and what each choice comes to."""
    n, copy = table(spark, sf, "nation"), F.lit(" (copy)")
    key_of = lambda title, author: F.concat(F.lit("k:"), title)
    held = n.filter("n_nationkey % 4 > 0").select(F.concat("n_name", F.repeat(copy, (F.col("n_nationkey") % 3).cast("int"))).alias("title")).union(n.filter("n_nationkey % 2 = 0").select("n_name")).distinct()
    choice = F.get(F.array(F.lit(None).cast("string"), F.lit("replace"), F.lit("skip"), F.lit("new")), (F.col("c_custkey") % 4).cast("int"))
    asked = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("seq"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("author"), choice.alias("resolution"))
    return L.creations(asked, held.withColumn("key", key_of(F.col("title"), None)), key_of).drop("author")


_FETCHES = "x AS (SELECT user_id AS course, event_type AS lang, ts AS came, event_id AS seq, ['ok', 'error', 'ok', 'gone', 'error', 'error'][1 + event_id * 7 % 6] AS outcome, 'view ' || event_id AS view FROM events)"


@query(f"""WITH {_FETCHES}, g AS (SELECT course || '/' || lang AS key, max((came, seq)) FILTER (outcome = 'ok') AS o, max((came, seq)) FILTER (outcome = 'gone') AS g, arg_max(view, (came, seq)) FILTER (outcome = 'ok') AS view,
      arg_max(came, (came, seq)) FILTER (outcome = 'ok') AS got, arg_max(outcome, (came, seq)) AS last FROM x GROUP BY ALL),
    s AS (SELECT key, CASE WHEN g IS NULL OR o > g THEN view END AS view, CASE WHEN g IS NULL OR o > g THEN got END AS fetched_at, nullif(last, 'ok') AS error FROM g)
    SELECT key, view, fetched_at, error, fetched_at IS NULL OR key LIKE '1%' OR fetched_at + INTERVAL 15 MINUTE <= (SELECT max(came) FROM x) AS fetch_again FROM s""")
def t8_last_good_views(spark, sf):
    """The view that each course shows after all its fetches, and whether it is asked for again."""
    n = F.col("event_id")
    outcome = F.get(F.array(*[F.lit(x) for x in ("ok", "error", "ok", "gone", "error", "error")]), (n * 7 % 6).cast("int"))
    e = table(spark, sf, "events")
    fetches = e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").alias("at"), n.alias("seq"), outcome.alias("outcome"), F.concat(F.lit("view "), n.cast("string")).alias("view"))
    now = e.agg(F.max("ts").alias("now")).withColumn("one", F.lit(1))
    shown = course.last_good(fetches, "key").withColumn("one", F.lit(1)).join(F.broadcast(now), "one")  # one row
    again = course.must_fetch(F.col("fetched_at"), F.col("now"), F.col("key").like("1%"))
    return shown.select("key", "view", "fetched_at", "error", again.alias("fetch_again"))
