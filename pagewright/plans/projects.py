"""Reconciling, the queue, resumed jobs, trash and detection: customers stand in for projects, orders and line items for receipts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import identity
from pagewright.functions import text as T
from pagewright.operators import matching as M
from pagewright.operators import queue as Q
from pagewright.plans.library import _PROJECTS, projects, with_status
from pagewright.plans.registry import query, table
from pagewright.sources import packages


@query("""WITH l AS (SELECT p_brand AS k, min(p_partkey) AS leader, arg_min(p_size, p_partkey) AS size FROM part GROUP BY p_brand),
    e AS (SELECT DISTINCT 'Brand#' || (s_nationkey + 10) AS k FROM supplier WHERE s_acctbal > 5000), n AS (SELECT k, 1 + size % 7 AS near FROM l WHERE size % 3 = 0)
    SELECT l.k AS key, leader, CASE WHEN e.k IS NOT NULL THEN 'merged' WHEN near IS NOT NULL THEN 'conflict' ELSE 'created' END AS outcome,
      CASE WHEN e.k IS NULL THEN near END AS near, row_number() OVER (ORDER BY l.k) AS place FROM l LEFT JOIN e USING (k) LEFT JOIN n ON n.k = l.k""")
def p10_reconcile_report(spark, sf):
    """Each candidate group merged into a project, in conflict with one, or created; ordered by key."""
    leaders = table(spark, sf, "part").groupBy(F.col("p_brand").alias("key")).agg(F.min("p_partkey").alias("leader"), F.min_by("p_size", "p_partkey").alias("size"))
    existing = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 10).cast("string")).alias("key"))
    near = leaders.filter("size % 3 = 0").select("key", (1 + F.col("size") % 7).alias("near"))
    report = Q.reconciled(leaders, existing, near, "key")
    rows = report.select("key", "leader", "outcome", "near", F.lit(0).alias("one"))
    return M.places(rows, "one", [F.left("key", F.lit(8))], ["key"], "place").drop("one")


@query("SELECT DISTINCT p_brand AS key FROM part WHERE p_brand IN (SELECT 'Brand#' || (s_nationkey + 10) FROM supplier)")
def j16_existing_projects(spark, sf):
    """Candidate keys that the store has."""
    held = table(spark, sf, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 10).cast("string")).alias("key"))
    return table(spark, sf, "part").select(F.col("p_brand").alias("key")).distinct().join(held, "key", "left_semi")


_TAKEN = "x AS (SELECT n_name || repeat(' (copy)', (n_nationkey % 4)::INT) AS title FROM nation UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name || ' (copy)' FROM nation WHERE n_nationkey % 5 < 3)"


@query(f"""WITH {_TAKEN}, w AS (SELECT n_name AS title, unnest(range(1, 101)) AS k FROM nation)
    SELECT title, title || repeat(' (copy)', (min(k) FILTER (title || repeat(' (copy)', k::INT) NOT IN (SELECT title FROM x)))::INT) AS copy FROM w GROUP BY title""")
def p14_copy_names(spark, sf):
    """The first free copy of a title that is taken."""
    n, key = table(spark, sf, "nation"), F.col("n_nationkey")
    copy = F.concat("n_name", F.lit(" (copy)"))
    parts = [n.select(F.concat("n_name", F.repeat(F.lit(" (copy)"), (key % 4).cast("int"))).alias("title")), n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("title")), n.filter("n_nationkey % 5 < 3").select(copy.alias("title"))]
    taken = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return Q.copy_names(n.select(F.col("n_name").alias("title")), taken, "title")


@query(f"WITH {_PROJECTS} SELECT segment, project, title, row_number() OVER (PARTITION BY segment ORDER BY title, project) AS place FROM s WHERE unfinished > 0 OR cursor < receipts OR (receipts = 0 AND confirmed)")
def t9_o2_queue(spark, sf):
    """The queue rebuilt from pending projects, by title."""
    c = F.col
    pending = projects(spark, sf).filter((c("unfinished") > 0) | (c("cursor") < c("receipts")) | ((c("receipts") == 0) & c("confirmed")))
    return pending.select("segment", "project", "title", F.row_number().over(Window.partitionBy("segment").orderBy("title", "project")).cast("long").alias("place"))


_RECEIPTS = "r AS (SELECT l_orderkey AS job, l_linenumber AS step, CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS lesson FROM lineitem)"


def receipts(spark, sf):
    lesson = F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("step"), lesson.alias("lesson"))


def steps(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step"))


@query(f"""WITH {_RECEIPTS}, s AS (SELECT o_orderkey AS job, unnest([1, 2, 3, 4]) AS step FROM orders), m AS (SELECT job, step, max(lesson) AS lesson FROM r GROUP BY ALL)
    SELECT s.job, s.step::INT AS step, lesson, lesson IS NULL AS to_do FROM s LEFT JOIN m USING (job, step)""")
def t10_resumed_steps(spark, sf):
    """Steps of every job with the lessons that are there already."""
    own = receipts(spark, sf).withColumn("step", F.col("step").cast("int"))
    return Q.resumed(steps(spark, sf), own, "job", "step", "lesson")


@query(f"WITH {_RECEIPTS}, d AS (SELECT job, max(step) + 1 AS c FROM r WHERE lesson IS NOT NULL GROUP BY job) SELECT o_orderkey AS job, greatest(o_custkey % 4, coalesce(c, 0))::BIGINT AS cursor FROM orders LEFT JOIN d ON job = o_orderkey")
def t10_cursors(spark, sf):
    """Each job's cursor, never moved back."""
    persisted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 4).alias("cursor"))
    return Q.cursors(receipts(spark, sf), persisted, "job", "step", "lesson", "cursor").select("job", F.col("cursor").cast("long").alias("cursor"))


@query(f"WITH {_RECEIPTS} SELECT job, array_to_string(list(lesson ORDER BY step, lesson), ',') AS lessons FROM r WHERE lesson IS NOT NULL GROUP BY job")
def a12_completed_lessons(spark, sf):
    """Uploaded lessons of every job, in the receipts' order."""
    out = Q.completed(receipts(spark, sf), "job", ["step"], "lesson")
    return out.select("job", F.array_join(F.transform("lessons", lambda x: x.cast("string")), ",").alias("lessons"))


@query(f"WITH {_RECEIPTS} SELECT job, step, lesson, row_number() OVER (PARTITION BY job ORDER BY step, lesson NULLS FIRST) AS place FROM r")
def t11_o5_replayed_receipts(spark, sf):
    """Receipts to show again, by index."""
    w = Window.partitionBy("job").orderBy("step", F.asc_nulls_first("lesson"))
    return receipts(spark, sf).withColumn("place", F.row_number().over(w).cast("long"))


_INPUTS = ["c_name", "c_nationkey", "c_mktsegment", "c_acctbal", "cover", "skipped", "mapping", "confirmed_at", "consent"]


@query("""WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 END AS mapping FROM customer)
    SELECT c_custkey, NOT (c_custkey % 7 = 1 OR c_custkey % 11 = 2 OR (c_custkey % 13 = 3 AND mapping IS NOT NULL)) AS unchanged FROM c""")
def t12_confirmations(spark, sf):
    """Whether a detection may still be confirmed: all nine inputs are as they were."""
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        "c_custkey", *_INPUTS[:4], (key % 2).alias("cover"), (key % 4).alias("skipped"), F.when(key % 3 == 0, key % 5).alias("mapping"),
        F.lit(None).cast("timestamp").alias("confirmed_at"), F.lit(True).alias("consent"),
    )
    then = rows.withColumns({
        "skipped": F.when(key % 7 == 1, F.col("skipped") + 1).otherwise(F.col("skipped")), "mapping": F.when(key % 13 == 3, None).otherwise(F.col("mapping")),
        "confirmed_at": F.when(key % 11 == 2, F.to_timestamp(F.lit("2024-01-01"))),
    })
    return Q.confirmed(rows, then, "c_custkey", _INPUTS).select("c_custkey", "unchanged")


@query(f"WITH {_PROJECTS} SELECT project, confirmed OR receipts > 0 AS startable FROM s")
def f13_startable(spark, sf):
    """A project starts once it is confirmed, or goes on where it has receipts."""
    return projects(spark, sf).select("project", (F.col("confirmed") | (F.col("receipts") > 0)).alias("startable"))


@query(f"WITH {_PROJECTS} SELECT project, o_custkey IS NOT NULL AS running FROM p LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = project")
def j22_running_flag(spark, sf):
    """Projects with a job among those that run."""
    jobs = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("project")).distinct().withColumn("_r", F.lit(True))
    return projects(spark, sf).join(jobs, "project", "left").select("project", F.col("_r").isNotNull().alias("running"))


@query("""SELECT user_id, count(*) AS accepted, arg_max(value, event_id) AS last_value FROM events WHERE event_id % 3 = user_id % 3 GROUP BY user_id""")
def t3_own_events(spark, sf):
    """Events of the current job alone, and the last value they leave."""
    own = table(spark, sf, "events").withColumns({"job": F.col("event_id") % 3, "current": F.col("user_id") % 3}).filter("job = current")
    return own.groupBy("user_id").agg(F.count("*").alias("accepted"), F.max_by("value", "event_id").alias("last_value"))


@query("""WITH l AS (SELECT n_nationkey AS pos, n_name AS language, count(c_custkey) FILTER (c_acctbal > 9000) AS known FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT language, known, known > 0 AS shown, row_number() OVER (ORDER BY known DESC, pos) AS place FROM l""")
def f11_o6_languages(spark, sf):
    """Languages by known words, and whether they are shown."""
    known = table(spark, sf, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("known"))
    rows = table(spark, sf, "nation").join(known, "n_nationkey", "left").fillna(0, ["known"])
    place = F.row_number().over(Window.orderBy(F.desc("known"), "n_nationkey")).cast("long")  # one row per language
    return rows.select(F.col("n_name").alias("language"), "known", (F.col("known") > 0).alias("shown"), place.alias("place"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(nfc_normalize(p_name)), lower(nfc_normalize('Small')))")
def f10_candidate_search(spark, sf):
    """Candidates whose title holds the words typed, whatever their case and form."""
    title = F.lower(T.normal_form("NFC")(F.col("p_name")))
    return table(spark, sf, "part").filter(F.contains(title, F.lit("small"))).select("p_partkey", "p_name")


@query("""WITH k AS (SELECT conv_id AS book, turn, CASE turn % 4 WHEN 0 THEN 'Preface' WHEN 1 THEN 'The  Rain' WHEN 2 THEN ' INDEX ' ELSE 'Chapter 1' END AS title FROM conversations)
    SELECT book, turn, turn % 4 = 0 OR turn % 4 = 2 AS matter, bool_and(turn % 4 IN (0, 2)) OVER (PARTITION BY book) AS only_matter FROM k""")
def f19_matter_ids(spark, sf):
    """Chapters that are front or back matter, and books that have nothing else."""
    names = F.create_map(*[F.lit(x) for x in (0, "Preface", 1, "The  Rain", 2, " INDEX ", 3, "Chapter 1")])
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), "turn", (T.matter_kind(names[(F.col("turn") % 4).cast("int")]) != "body").alias("matter"))
    all_of = rows.groupBy("book").agg(F.bool_and("matter").alias("only_matter"))
    return rows.join(all_of, "book").select("book", "turn", "matter", "only_matter")


@query("""WITH t AS (SELECT conv_id AS book, array_agg(DISTINCT turn) AS had FROM conversations WHERE turn % 3 = 0 GROUP BY 1)
    SELECT conv_id AS book, turn, (turn % 3 = 0) <> (role = 'user') AS skipped FROM conversations""")
def u4_toggled_skips(spark, sf):
    """The skip set after each chapter of one role is toggled."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), "turn", "role")
    had = c.filter("turn % 3 = 0").select("book", "turn", F.lit(True).alias("_h"))
    flipped = c.filter("role = 'user'").select("book", "turn", F.lit(True).alias("_f"))
    rows = c.join(had.distinct(), ["book", "turn"], "left").join(flipped.distinct(), ["book", "turn"], "left")
    return rows.select("book", "turn", (F.col("_h").isNotNull() != F.col("_f").isNotNull()).alias("skipped"))


_WINDOWS = """b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN 40.0 ELSE 0.0 END AS s, CASE WHEN l_partkey % 5 = 0 THEN 30.0 + l_quantity ELSE 2 * l_quantity END AS e, 2 * l_quantity AS d FROM lineitem),
    v AS (SELECT *, CASE WHEN least(e, d) <= s THEN 0 ELSE s END AS a, CASE WHEN least(e, d) <= s THEN d ELSE least(e, d) END AS z FROM b)"""


@query(f"""WITH {_WINDOWS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN least(a + 35, z) - (a + 5) >= 10 THEN least(a + 35, z) END AS head_to,
      CASE WHEN least(a + 65, z) - (a + 35) >= 10 THEN a + 35 END AS retry_from, CASE WHEN (z - 5) - greatest(a, z - 35) >= 10 THEN greatest(a, z - 35) END AS tail_from,
      CASE WHEN (z - 35) - greatest(a, z - 65) >= 10 THEN greatest(a, z - 65) END AS tail_retry_from FROM v""")
def w10_sample_windows(spark, sf):
    """Head and tail windows of every track, with a second try where there is sound enough."""
    odd, q = F.col("l_partkey") % 5 == 0, F.col("l_quantity")
    own = Q.bounds(F.when(odd, 40.0), F.when(odd, 30.0 + q), 2 * q, F.lit(None).cast("double"))
    rows = table(spark, sf, "lineitem").withColumn("_b", own)
    w = Q.sample_windows(F.col("_b.from"), F.col("_b.to"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rows.select(*keys, w["head"]["to"].alias("head_to"), w["head_retry"]["from"].alias("retry_from"), w["tail"]["from"].alias("tail_from"), w["tail_retry"]["from"].alias("tail_retry_from"))


@query("""WITH t AS (SELECT l_orderkey AS book, (l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_suppkey % 4 AS path, CASE WHEN l_partkey % 5 = 0 THEN l_quantity END AS s, CASE WHEN l_partkey % 5 = 0 THEN 3 * l_quantity - 9 END AS e,
      CASE WHEN l_partkey % 7 > 0 THEN 3 * l_quantity ELSE 60.0 END AS d FROM lineitem),
    v AS (SELECT *, CASE WHEN least(coalesce(e, d), d) <= coalesce(s, 0) THEN 0 ELSE coalesce(s, 0) END AS a, CASE WHEN least(coalesce(e, d), d) <= coalesce(s, 0) THEN d ELSE least(coalesce(e, d), d) END AS z FROM t),
    g AS (SELECT book, count(*) AS k, arg_min({'p': path, 's': s, 'a': a, 'z': z}, n) AS h, arg_max({'p': path, 's': s, 'a': a, 'z': z}, n) AS l FROM v GROUP BY book),
    o AS (SELECT *, k = 1 OR (h.p = l.p AND h.s IS NULL AND l.s IS NULL) AS alone FROM g),
    m AS (SELECT *, CASE WHEN alone AND h.z - h.a >= 30 THEN (h.a + h.z) / 2 END AS middle FROM o),
    c AS (SELECT book, h.a AS ha, CASE WHEN alone THEN middle ELSE h.z END AS hz, CASE WHEN alone THEN middle ELSE l.a END AS ta, CASE WHEN alone THEN h.z ELSE l.z END AS tz FROM m),
    f AS (SELECT *, coalesce(least(ha + 35, hz) - (ha + 5) >= 10 AND (tz - 5) - greatest(ta, tz - 35) >= 10, false) AND hz IS NOT NULL AND ta IS NOT NULL AS fine FROM c)
    SELECT book, CASE WHEN fine THEN ha + 5 END AS head_from, CASE WHEN fine THEN least(ha + 35, hz) END AS head_to, CASE WHEN fine AND least(ha + 65, hz) - (ha + 35) >= 10 THEN least(ha + 65, hz) END AS head_retry_to,
      CASE WHEN fine THEN greatest(ta, tz - 35) END AS tail_from, CASE WHEN fine AND (tz - 35) - greatest(ta, tz - 65) >= 10 THEN greatest(ta, tz - 65) END AS tail_retry_from,
      CASE WHEN NOT fine THEN 'insufficient audio' END AS error FROM f""")
def w10_sample_plans(spark, sf):
    """Sample windows of every book: head of its first track, tail of its last, a single file split at its middle."""
    cut, q = F.col("l_partkey") % 5 == 0, F.col("l_quantity")
    tracks = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("book"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_suppkey") % 4).alias("path"), F.when(cut, q).alias("start"), F.when(cut, 3 * q - 9).alias("end"),
        F.when(F.col("l_partkey") % 7 > 0, 3 * q).otherwise(0.0).alias("probed"), F.lit(60.0).alias("declared"),
    )
    plans = Q.sample_plans(tracks, "book", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "path")
    return plans.select("book", F.col("head.from").alias("head_from"), F.col("head.to").alias("head_to"), F.col("head_retry.to").alias("head_retry_to"), F.col("tail.from").alias("tail_from"), F.col("tail_retry.from").alias("tail_retry_from"), "error")


@query("""WITH d AS (SELECT doc_id, n_chars / 1000.0 AS confidence, CASE WHEN doc_id % 2 = 0 THEN 'title' ELSE 'transcript' END AS source, CASE WHEN doc_id % 3 = 0 THEN 'x' END AS provider, substr(text, 1, 300) AS head FROM documents)
    SELECT doc_id, CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'confidence' WHEN NOT coalesce((source = 'title' AND provider IS NULL) OR (source = 'transcript' AND provider IS NOT NULL), false) THEN 'provider'
      WHEN length(head) > 240 THEN 'preview' END AS error FROM d""")
def f20_preview_errors(spark, sf):
    """Detection previews that are refused, with the reason."""
    key = F.col("doc_id")
    error = Q.preview_error(
        F.col("n_chars") / 1000.0, F.when(key % 2 == 0, "title").otherwise("transcript"), F.when(key % 3 == 0, "x"), F.left("text", F.lit(300)), F.lit(None).cast("string")
    )
    return table(spark, sf, "documents").select("doc_id", error.alias("error"))


@query("""WITH b AS (SELECT conv_id AS book, min(turn) FILTER (role = 'user') AS s, max(turn) FILTER (role = 'user') AS e, min(turn) FILTER (role = 'assistant') AS a, max(turn) FILTER (role = 'assistant') AS z FROM conversations GROUP BY 1)
    SELECT book, CASE WHEN a IS NULL THEN 'changed' WHEN s < a OR e > z THEN 'outside' END AS error FROM b""")
def f21_selected_ranges(spark, sf):
    """Selected ranges that reach beyond the detected one."""
    of = lambda f, role: f(F.when(F.col("role") == role, F.col("turn")))
    b = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("book")).agg(of(F.min, "user").alias("s"), of(F.max, "user").alias("e"), of(F.min, "assistant").alias("a"), of(F.max, "assistant").alias("z"))
    return b.select("book", F.when(F.col("a").isNull(), "changed").when((F.col("s") < F.col("a")) | (F.col("e") > F.col("z")), "outside").alias("error"))


_MARKS = """c AS (SELECT source, page_id, lower(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS t FROM (SELECT page_id % 50 AS source, page_id, CASE page_id % 9 WHEN 0 THEN replace(html, '<p', '<p class="kobospan"')
      WHEN 1 THEN replace(html, '<div', '<div class="font-140per"') WHEN 2 THEN html || '<!-- kf8 --> KF8' ELSE html END AS html FROM pages)),
    k AS (SELECT source, len(regexp_extract_all(t, 'kobospan')) + len(regexp_extract_all(t, 'font-1[246]0per')) AS kobo, len(regexp_extract_all(t, 'amzn-page-break|kindle:embed|kindle:position|kf8|"calibre')) AS kindle FROM c),
    g AS (SELECT source, max(kobo) AS most, sum(kobo)::BIGINT AS total, count(*) FILTER (kobo > 0) AS files, sum(kindle)::BIGINT AS kindle, source % 4 = 0 AS ncx FROM k GROUP BY source)"""


@query(f"""WITH {_MARKS} SELECT source, CASE WHEN most >= 3 OR files >= 3 THEN 'kobo' WHEN ncx OR kindle >= 2 THEN 'kindle' ELSE 'generic' END AS vendor,
    round(CASE WHEN most >= 3 OR files >= 3 THEN least(0.99, 0.6 + least(total, 12) / 30) WHEN kindle >= 2 OR (ncx AND kindle >= 1) THEN least(0.99, 0.6 + least(kindle, 8) / 20) WHEN ncx THEN 0.6
      WHEN total + kindle = 0 THEN 0.2 ELSE 0.35 END, 6) AS confidence,
    'kobo_x' || CASE WHEN most >= 12 THEN '12+' WHEN most >= 6 THEN '6+' WHEN most >= 3 THEN '3+' ELSE most::VARCHAR END AS label FROM g""")
def a9_c28_vendors(spark, sf):
    """Vendor of each package by the markers of its files."""
    n, html = F.col("page_id") % 9, F.col("html")
    marked = (
        F.when(n == 0, F.replace(html, F.lit("<p"), F.lit('<p class="kobospan"'))).when(n == 1, F.replace(html, F.lit("<div"), F.lit('<div class="font-140per"')))
        .when(n == 2, F.concat(html, F.lit("<!-- kf8 --> KF8"))).otherwise(html)
    )
    kobo, kindle = Q.marker_counts(F.col("b"))
    files = table(spark, sf, "pages").select((F.col("page_id") % 50).alias("source"), marked.alias("b")).select("source", kobo.alias("kobo"), kindle.alias("kindle"))
    g = files.groupBy("source").agg(F.max("kobo").alias("most"), F.sum("kobo").alias("total"), F.count_if(F.col("kobo") > 0).alias("files"), F.sum("kindle").alias("kindle"))
    kind, sure = Q.vendor(F.col("most"), F.col("total"), F.col("files"), F.col("kindle"), F.col("source") % 4 == 0)
    return g.select("source", kind.alias("vendor"), F.round(sure, 6).alias("confidence"), T.signal_label("kobo", F.col("most")).alias("label"))


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'img/' || p_partkey || '.png' END AS a, CASE WHEN p_size % 5 = 0 THEN 'meta.jpg' END AS b, CASE WHEN p_size % 3 = 0 THEN 'guide.jpg' END AS c, CASE WHEN p_size % 2 = 0 THEN 'cover.jpg' END AS d FROM part)
    SELECT p_partkey, coalesce(a, b, c, d) AS href, CASE WHEN a IS NOT NULL THEN 'property' WHEN b IS NOT NULL THEN 'meta' WHEN c IS NOT NULL THEN 'guide' WHEN d IS NOT NULL THEN 'name' END AS rung,
      CASE WHEN a IS NOT NULL THEN 'cover.png' WHEN coalesce(b, c, d) IS NOT NULL THEN 'cover.jpg' END AS sidecar FROM r""")
def j23_k7_covers(spark, sf):
    """The cover by the first rule that finds one, and the name it is kept under."""
    size = F.col("p_size")
    found = Q.first_rung(
        ("property", F.when(size % 7 == 0, F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png")))), ("meta", F.when(size % 5 == 0, "meta.jpg")),
        ("guide", F.when(size % 3 == 0, "guide.jpg")), ("name", F.when(size % 2 == 0, "cover.jpg")),
    )
    rows = table(spark, sf, "part").withColumn("_c", found)
    mime = F.when(T.extension(F.col("_c.href")) == "png", "image/png").when(F.col("_c").isNotNull(), "image/jpeg")
    return rows.select("p_partkey", F.col("_c.href").alias("href"), F.col("_c.rung").alias("rung"), Q.cover_name(mime).alias("sidecar"))


@query("""WITH t AS (SELECT o_custkey AS slug, o_orderdate::DATE AS day, o_orderkey AS seq FROM orders WHERE o_orderstatus = 'F')
    SELECT slug, seq, slug || '-' || strftime(day, '%Y-%m-%d') || CASE WHEN row_number() OVER w > 1 THEN '-' || (row_number() OVER w - 1) ELSE '' END AS slot,
      slug NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS restorable FROM t WINDOW w AS (PARTITION BY slug, day ORDER BY seq)""")
def k4_s21_trash(spark, sf):
    """Slots of trashed projects, and whether they can come back."""
    t = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("slug"), F.col("o_orderdate").cast("date").alias("at"), F.col("o_orderkey").alias("seq"))
    slots = Q.trash_slots(t.withColumn("name", F.col("slug").cast("string")), "name", "at")
    live = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("slug"))
    free = Q.restorable(slots.select("slug").distinct(), live, "slug").withColumn("_f", F.lit(True))
    return slots.join(free, "slug", "left").select("slug", "seq", "slot", F.col("_f").isNotNull().alias("restorable"))


@query("""WITH f AS (SELECT p_brand AS book, p_partkey, CASE WHEN p_size % 6 = 0 THEN '' ELSE '/audio/' || replace(p_name, ' ', '_') || '.mp3' END AS path FROM part)
    SELECT book, count(*) FILTER (path <> '') AS files, CASE WHEN count(*) FILTER (path <> '') > 1 THEN 'multiple' WHEN count(*) FILTER (path <> '') = 1 THEN 'single' END AS kind,
      arg_min(regexp_extract(path, '/([^/]*)\\.mp3$', 1), p_partkey) FILTER (path <> '') AS title FROM f GROUP BY book""")
def s6_c23_manual_candidates(spark, sf):
    """Candidates from files picked by hand: at least one sound file, titled by the first one's stem."""
    path = F.when(F.col("p_size") % 6 == 0, "").otherwise(F.concat(F.lit("/audio/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".mp3")))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("book"), "p_partkey", F.nullif(path, F.lit("")).alias("path"))
    files = F.count("path")
    title = F.min_by(F.when(F.col("path").isNotNull(), T.audio_title(F.col("path"), F.lit(0))), F.when(F.col("path").isNotNull(), F.col("p_partkey")))
    return rows.groupBy("book").agg(files.alias("files"), F.when(files > 1, "multiple").when(files == 1, "single").alias("kind"), title.alias("title"))


@query("""SELECT p_partkey, lower(p_name) || ' ' || p_size AS shown, sha256(lower(p_name) || ' ' || p_size) AS title_hash FROM part""")
def c2_c4_title_forms(spark, sf):
    """Shown form and hash of titles with wide letters, wide spaces and what shows nothing: as of the plain titles that the SQL has."""
    key, plain = F.col("p_partkey"), F.concat_ws("  ", "p_name", F.col("p_size").cast("string"))
    wide = F.when(key % 3 == 0, F.translate(plain, "abcdeghino 0123456789", "ａｂＣｄｅｇｈｉｎｏ\u3000０１２３４５６７８９")).otherwise(F.upper(plain))
    unseen = F.when(key % 5 < 2, F.regexp_replace(wide, "[rtｔ]", "$0\u200b")).otherwise(wide)
    return table(spark, sf, "part").select("p_partkey", T.shown_title(unseen).alias("shown"), identity.title_hash(wide).alias("title_hash"))


@query("""WITH k AS (SELECT o_orderkey, list_position(['P', 'O', 'F'], o_orderstatus) AS now, 1 + o_custkey % 6 AS wanted FROM orders), s AS (SELECT ['new', 'parsed', 'mapped', 'transcoded', 'uploaded', 'done'] AS s)
    SELECT o_orderkey, s[now * 2 - 1] AS stage, CASE WHEN wanted >= now * 2 - 1 THEN s[wanted] END AS stepped, s[now * 2] AS following FROM k, s""")
def c26_stages(spark, sf):
    """Stages after a step, null where it would go back, and the stage that follows."""
    names = F.array(*[F.lit(x) for x in T.STAGES])
    now = F.get(names, (F.array_position(F.array(F.lit("P"), F.lit("O"), F.lit("F")), F.col("o_orderstatus")) * 2 - 2).cast("int"))
    wanted = F.get(names, (F.col("o_custkey") % 6).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", now.alias("stage"), T.stage_step(now, wanted).alias("stepped"), T.next_stage(now).alias("following"))


_TAGS = "g AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-XX' WHEN 2 THEN 'jpn' WHEN 3 THEN 'swe' WHEN 4 THEN 'qq_ZZ' ELSE 'x' END AS tag FROM documents)"


@query(f"""WITH {_TAGS} SELECT doc_id, CASE WHEN tag IS NULL THEN NULL WHEN doc_id % 6 IN (0, 1) THEN lang ELSE ['ja', 'sw', 'xx', ''][doc_id % 6 - 1] END AS folded,
    CASE WHEN doc_id % 6 = 0 THEN lang WHEN doc_id % 6 = 2 THEN 'ja' END AS hint FROM g JOIN documents USING (doc_id)""")
def c19_c20_languages(spark, sf):
    """Language tags folded to two letters, and the hint a transcription service gets."""
    lang, k = F.col("lang"), F.col("doc_id") % 6
    tag = F.when(k == 0, lang).when(k == 1, F.concat(F.upper(lang), F.lit("-XX"))).when(k == 2, "jpn").when(k == 3, "swe").when(k == 4, "qq_ZZ").otherwise("x")
    return table(spark, sf, "documents").select("doc_id", T.fold_language(tag).alias("folded"), T.provider_hint(tag).alias("hint"))


@query("""SELECT o_orderpriority AS band, count(*) AS cases, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 9) AS top1_recall,
    count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) >= 0.9 AS passes FROM orders GROUP BY 1""")
def a16_top1_recall(spark, sf):
    """Share of cases whose best candidate is the right one, against the floor."""
    share = F.count_if(F.col("o_orderstatus") == "F") / F.count("*")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("band")).agg(F.count("*").alias("cases"), F.round(share, 9).alias("top1_recall"), (share >= 0.9).alias("passes"))


@query(f"WITH {_PROJECTS} SELECT segment, status, count(*) AS projects, max(activity) AS last_activity FROM s GROUP BY ALL")
def a8_shelf_statuses(spark, sf):
    """Projects by shelf and status, with their last activity."""
    return with_status(spark, sf).groupBy("segment", "status").agg(F.count("*").alias("projects"), F.max("activity").alias("last_activity"))


_TRASHED = """t AS (SELECT o_custkey AS slug, o_orderkey AS seq, o_custkey || '-' || o_orderkey AS slot FROM orders WHERE o_orderstatus = 'F'),
    q AS (SELECT o_orderkey * 2 + k AS seq, CASE WHEN (o_orderkey + k) % 3 = 0 THEN 'purge' ELSE 'restore' END AS action, o_custkey || '-' || o_orderkey AS slot FROM orders, (SELECT unnest([0, 1]) AS k) WHERE o_orderkey % 2 = 0),
    h AS (SELECT q.*, slug, slug IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS taken FROM q LEFT JOIN t USING (slot)),
    a AS (SELECT *, slug IS NOT NULL AND NOT taken AND action = 'restore' AND NOT coalesce(bool_or(slug IS NOT NULL AND action = 'purge') OVER w, false) AS may, coalesce(bool_or(slug IS NOT NULL AND action = 'purge') OVER w, false) AS purged
          FROM h WINDOW w AS (PARTITION BY slot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, coalesce(bool_or(may) OVER (PARTITION BY slug ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS placed FROM a),
    c AS (SELECT *, purged OR coalesce(bool_or(may AND NOT placed) OVER (PARTITION BY slot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM b)"""


@query(f"""WITH {_TRASHED} SELECT seq, action, slot, CASE WHEN slug IS NULL OR gone THEN 'not found' WHEN action = 'purge' THEN 'purged' WHEN may AND NOT placed THEN 'restored' ELSE 'conflict' END AS answer FROM c""")
def k4_trash_requests(spark, sf):
    """What restoring and purging trashed projects comes to, in turn."""
    orders, slot = table(spark, sf, "orders"), F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    trashed = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("slug"), slot.alias("slot"))
    asked = orders.filter("o_orderkey % 2 = 0").select("o_orderkey", slot.alias("slot"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    asked = asked.select((F.col("o_orderkey") * 2 + F.col("k")).alias("seq"), F.when((F.col("o_orderkey") + F.col("k")) % 3 == 0, "purge").otherwise("restore").alias("action"), "slot")
    live = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("slug"))
    return Q.trash_requests(asked, trashed, live, "slug")


_OPS = """o AS (SELECT user_id, event_id, CASE WHEN event_id * 7 % 11 < 6 THEN 'push' ELSE 'advance' END AS op, CASE WHEN event_id * 7 % 11 < 6 THEN event_id * 3 END AS job FROM events),
    s AS (SELECT *, sum((op = 'push')::INT) OVER w AS pushed, sum(CASE WHEN op = 'push' THEN 1 ELSE -1 END) OVER w AS total FROM o WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    m AS (SELECT *, -least(0, min(total) OVER (PARTITION BY user_id ORDER BY event_id)) AS missed FROM s),
    t AS (SELECT *, total + missed AS length, pushed - total - missed AS taken FROM m),
    k AS (SELECT *, CASE WHEN taken > coalesce(lag(taken) OVER (PARTITION BY user_id ORDER BY event_id), 0) THEN taken END AS took FROM t)"""


@query(f"""WITH {_OPS} SELECT k.user_id, k.event_id, k.op, k.job, k.length::BIGINT AS length, f.job AS current, p.job AS popped FROM k
    LEFT JOIN k f ON f.op = 'push' AND f.user_id = k.user_id AND f.pushed = CASE WHEN k.length > 0 THEN k.taken + 1 END LEFT JOIN k p ON p.op = 'push' AND p.user_id = k.user_id AND p.pushed = k.took""")
def t9_queue_states(spark, sf):
    """Each user's queue after every push and advance."""
    push = F.col("event_id") * 7 % 11 < 6
    ops = table(spark, sf, "events").select("user_id", "event_id", F.when(push, "push").otherwise("advance").alias("op"), F.when(push, F.col("event_id") * 3).alias("job"))
    return Q.queue_states(ops, "user_id", "event_id")


_PACKAGES = """p AS (SELECT page_id % 50 AS package, page_id, CASE page_id % 9 WHEN 0 THEN replace(html, '<p', '<p class="kobospan"') WHEN 1 THEN replace(html, '<div', '<div class="font-140per"') WHEN 2 THEN html || '<!-- kf8 --> KF8' ELSE html END AS html FROM pages),
    l AS (SELECT package, page_id, lower(regexp_replace(left(html, 65536), '(?s)<!--.*?(?:-->|\\z)', '', 'g')) AS t, row_number() OVER (PARTITION BY package ORDER BY page_id) AS n FROM p),
    c AS (SELECT package, len(regexp_extract_all(t, 'kobospan')) AS span, len(regexp_extract_all(t, 'font-1[246]0per')) AS font, len(regexp_extract_all(t, 'amzn-page-break|kindle:embed|kindle:position|kf8|"calibre')) AS kindle FROM l WHERE n <= 12),
    g AS (SELECT package, max(span) AS span, max(font) AS font, max(span + font) AS most, sum(span + font)::BIGINT AS total, count(*) FILTER (span + font > 0) AS files, sum(kindle)::BIGINT AS kindle, package % 4 = 0 AS ncx FROM c GROUP BY package)"""


def _label(name: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN '{name}_x' || CASE WHEN {n} >= 12 THEN '12+' WHEN {n} >= 6 THEN '6+' WHEN {n} >= 3 THEN '3+' ELSE {n}::VARCHAR END END"


def package_entries(spark, sf):
    """Pages as the entries of packages, some marked as shops mark theirs; every fourth package has a table of contents of the old kind."""
    n, html = F.col("page_id") % 9, F.col("html")
    marked = (
        F.when(n == 0, F.replace(html, F.lit("<p"), F.lit('<p class="kobospan"'))).when(n == 1, F.replace(html, F.lit("<div"), F.lit('<div class="font-140per"')))
        .when(n == 2, F.concat(html, F.lit("<!-- kf8 --> KF8"))).otherwise(html)
    )
    package = (F.col("page_id") % 50).cast("string")
    pages = table(spark, sf, "pages").select(package.alias("path"), F.format_string("p%d.xhtml", "page_id").alias("entry"), F.col("page_id").alias("place"), F.left(marked, F.lit(65536)).alias("looked"))
    contents = pages.filter("cast(path as int) % 4 = 0").groupBy("path").agg(F.lit("toc.ncx").alias("entry"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("looked"))
    return pages.unionByName(contents).withColumn("error", F.lit(None).cast("string"))


@query(f"""WITH {_PACKAGES} SELECT package::VARCHAR AS package, CASE WHEN most >= 3 OR files >= 3 THEN 'kobo' WHEN ncx OR kindle >= 2 THEN 'kindle' ELSE 'generic' END AS vendor,
    round(CASE WHEN most >= 3 OR files >= 3 THEN least(0.99, 0.6 + least(total, 12) / 30) WHEN kindle >= 2 OR (ncx AND kindle >= 1) THEN least(0.99, 0.6 + least(kindle, 8) / 20) WHEN ncx THEN 0.6
      WHEN total + kindle = 0 THEN 0.2 ELSE 0.35 END, 6) AS confidence,
    concat_ws(',', {_label('kobo_span', 'span')}, {_label('font_per', 'font')}, {_label('kindle_marker', 'kindle')}, CASE WHEN ncx THEN 'toc_ncx' END) AS signals FROM g""")
def a9_c28_package_vendors(spark, sf):
    """Vendor, confidence and all labels of packages, by what is looked at of their first pages."""
    found = packages.vendors(package_entries(spark, sf))
    return found.select(F.col("path").alias("package"), "vendor", F.round("confidence", 6).alias("confidence"), F.array_join("signals", ",").alias("signals"))


_SHELVES = """s AS (SELECT page_id % 40 AS package, page_id, 'p' || page_id || '.xhtml' AS entry, page_id AS place, CASE WHEN length(html) % 3 > 0 THEN 'img/' || (page_id // 40 % 6) || '.jpg' END AS shown FROM pages),
    i AS (SELECT DISTINCT package, k, CASE WHEN k = 5 AND package % 7 = 0 THEN 'img/cover.png' ELSE 'img/' || k || '.jpg' END AS entry FROM s, (SELECT unnest(range(6)) AS k)),
    h AS (SELECT package, shown AS entry, arg_min(entry, page_id) AS host FROM s WHERE shown IS NOT NULL GROUP BY ALL),
    g AS (SELECT package, arg_min(shown, page_id) AS entry, arg_min(entry, page_id) AS page FROM s WHERE shown IS NOT NULL AND package % 2 = 0 GROUP BY package),
    f AS (SELECT package, entry, 1 AS rank, k AS n, 'property' AS rung, NULL AS page FROM i WHERE package % 5 = 0 AND k IN (2, 3) UNION ALL SELECT package, entry, 2, k, 'meta', NULL FROM i WHERE package % 3 = 0 AND k = 1
      UNION ALL SELECT package, entry, 3, 0, 'guide', page FROM g UNION ALL SELECT package, entry, 4, k, 'name', NULL FROM i WHERE entry = 'img/cover.png'),
    o AS (SELECT package, unnest(arg_min({'entry': entry, 'rung': rung, 'page': page}, (rank, n))) FROM f GROUP BY package)"""


@query(f"""WITH {_SHELVES} SELECT o.package::VARCHAR AS package, rung, o.entry, 'cover.' || right(o.entry, 3) AS sidecar, CASE WHEN rung = 'guide' THEN page WHEN rung <> 'name' THEN host END AS host
    FROM o LEFT JOIN h ON h.package = o.package AND h.entry = o.entry""")
def j23_package_covers(spark, sf):
    """Covers of packages by the first of four rules, and the page that shows each."""
    key, package = F.col("page_id"), F.col("page_id") % 40
    shown = F.when(F.length("html") % 3 > 0, F.format_string("img/%d.jpg", F.floor(key / 40) % 6))
    pages = table(spark, sf, "pages").select(package.alias("package"), F.format_string("p%d.xhtml", key).alias("entry"), key.alias("place"), shown.alias("first_image"))
    first = pages.filter("first_image is not null and package % 2 = 0").groupBy("package").agg(F.min_by("entry", "place").alias("entry"), F.lit(True).alias("is_guide_cover"))
    pages = pages.join(first, ["package", "entry"], "left").select("package", "entry", "place", "first_image", F.coalesce("is_guide_cover", F.lit(False)).alias("is_guide_cover"), F.lit(None).cast("long").alias("k"))
    k = F.col("k")
    images = pages.select("package").distinct().select("package", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("k"))
    name = F.when((k == 5) & (F.col("package") % 7 == 0), "img/cover.png").otherwise(F.format_string("img/%d.jpg", k))
    images = images.select("package", name.alias("entry"), k.alias("place"), F.lit(None).cast("string").alias("first_image"), F.lit(False).alias("is_guide_cover"), "k")
    kind = F.when(k.isNull(), "application/xhtml+xml").when(F.col("entry").endswith("png"), "image/png").otherwise("image/jpeg")
    rows = pages.unionByName(images).select(
        F.col("package").cast("string").alias("path"), "entry", "place", "first_image", "is_guide_cover", kind.alias("media_type"), F.coalesce(k, F.col("place")).alias("manifest_pos"),
        F.when(k.isNull(), F.col("place")).alias("spine_pos"), F.coalesce((F.col("package") % 5 == 0) & k.isin(2, 3), F.lit(False)).alias("is_cover_property"),
        F.coalesce((F.col("package") % 3 == 0) & (k == 1), F.lit(False)).alias("is_cover_meta"), F.lit(None).cast("string").alias("error"),
    )
    return packages.covers(rows).select(F.col("path").alias("package"), "rung", "entry", "sidecar", "host")
