"""Text functions on documents, pages and names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.functions import identity
from pagewright.functions import text as T
from pagewright.operators import alignment, detection, library, similarity
from pagewright.plans.registry import query, table


@query("""SELECT doc_id, length(a) AS chars, md5(a) AS text_md5 FROM (SELECT doc_id,
      trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS a FROM documents)""")
def c1_alignment_text(spark, sf):
    """Texts reduced to letters, numbers and single spaces."""
    a = T.alignment_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", a.alias("a")).select("doc_id", F.length("a").cast("long").alias("chars"), F.md5("a").alias("text_md5"))


@query("""SELECT doc_id, sha256(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) || chr(31) || lower(coalesce(source, ''))) AS content_hash FROM documents""")
def c3_content_hash(spark, sf):
    """Identity hash of title and author (text and source)."""
    return table(spark, sf, "documents").select("doc_id", identity.content_hash(F.col("text"), F.col("source")).alias("content_hash"))


_HASHED = "h AS (SELECT doc_id, source, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS title_hash FROM documents)"


def hashed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", identity.title_hash(F.col("text")).alias("title_hash"))


@query(f"WITH {_HASHED} SELECT doc_id, title_hash FROM h WHERE source <> 'src0' AND title_hash NOT IN (SELECT title_hash FROM h WHERE source = 'src0' AND title_hash IS NOT NULL)")
def j13_lesson_antijoin(spark, sf):
    """Lessons that the collection does not have yet, by title hash."""
    rows = hashed(spark, sf)
    return rows.filter("source <> 'src0'").join(rows.filter("source = 'src0'"), "title_hash", "left_anti").select("doc_id", "title_hash")


@query(f"""WITH {_HASHED} SELECT a.doc_id, min(b.doc_id) AS found FROM h a JOIN h b ON a.title_hash = b.title_hash AND b.source = 'src0' WHERE a.source <> 'src0' GROUP BY a.doc_id""")
def j14_collection_search(spark, sf):
    """The first collection with the same title hash."""
    rows = hashed(spark, sf)
    first = rows.filter("source = 'src0'").groupBy("title_hash").agg(F.min("doc_id").alias("found"))
    return rows.filter("source <> 'src0'").join(first, "title_hash").select("doc_id", "found")


_WS = r"\t\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RAW = "|".join(rf"<{n}(?:[/ \t\r\n][^>]*)?/>|<{n}[>/ \t\r\n](?s:.*?)(?:</{n}[^>]*(?:>|\z)|\z)" for n in ("style", "script", "head"))


def _body(x: str) -> str:
    text = f"regexp_replace({x}, '(?is){_RAW}|<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&apos;", "chr(39)"), ("&#x3000;", "chr(12288)"), ("&amp;", "'&'")):
        text = f"replace({text}, '{entity}', {char})"
    text = rf"regexp_replace(regexp_replace({text}, '[{_WS}]*\n[{_WS}]*', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({text}, '^[\n{_WS}]+', ''), '[\n{_WS}]+$', '')"


@query(f"SELECT page_id, length(b) AS chars, md5(b) AS body_md5 FROM (SELECT page_id, {_body('html')} AS b FROM pages)")
def c14_clean_body(spark, sf):
    """Pages as text."""
    rows = table(spark, sf, "pages").select("page_id", T.clean_body(F.col("html")).alias("b"))
    return rows.select("page_id", F.length("b").cast("long").alias("chars"), F.md5("b").alias("body_md5"))


_TITLE = _body(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_HEADS = ", ".join("nullif(" + _body(rf"regexp_extract(html, '(?is)<h{k}[^>]*>(.*?)</h{k}>', 1)") + ", '')" for k in (1, 2, 3))


@query(f"""SELECT page_id, CASE WHEN lower(t) NOT IN ('', 'page', 'untitled') THEN t END AS title, coalesce({_HEADS}) AS heading FROM (SELECT *, {_TITLE} AS t FROM pages)""")
def c15_c16_titles(spark, sf):
    """Title and first heading of pages."""
    return table(spark, sf, "pages").select("page_id", T.head_title(F.col("html")).alias("title"), T.heading(F.col("html")).alias("heading"))


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, {_TITLE} AS title FROM pages)
    SELECT page_id, host, title, count(*) OVER (PARTITION BY host, title) > 1 AS repeated FROM p""")
def a10_repeated_titles(spark, sf):
    """Titles that a host repeats are names of the book, not of a chapter."""
    title = T.clean_body(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), title.alias("title"))
    often = rows.groupBy("host", "title").agg((F.count("*") > 1).alias("repeated"))
    return rows.join(often.withColumnsRenamed({"host": "_h", "title": "_t"}), F.col("host").eqNullSafe(F.col("_h")) & F.col("title").eqNullSafe(F.col("_t"))).drop("_h", "_t")


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, count(*) AS files, max(m)::BIGINT AS most, sum(m)::BIGINT AS total, sum((m > 0)::INT)::BIGINT AS files_hit,
      CASE WHEN sum(m) >= 3 THEN 'marked' ELSE 'plain' END AS vendor
    FROM (SELECT url, len(regexp_extract_all(html, '<li>')) AS m FROM pages) GROUP BY 1""")
def a9_vendor_markers(spark, sf):
    """Marker counts of each host's files."""
    rows = table(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("m"))
    return rows.groupBy("host").agg(
        F.count("*").alias("files"), F.max("m").alias("most"), F.sum("m").alias("total"), F.count_if(F.col("m") > 0).alias("files_hit"),
        F.when(F.sum("m") >= 3, "marked").otherwise("plain").alias("vendor"),
    )


_NAMES = "n AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_brand AS t FROM part), q AS (SELECT a.t AS a, b.t AS b FROM n a JOIN n b ON a.t < b.t)"


def names(spark, sf):
    return table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t")).distinct()


@query(f"""WITH {_NAMES}, x AS (SELECT t, list_distinct(list_transform(range(1, len(x)), lambda i: substr(x, i, 2))) AS g FROM (SELECT t, replace(lower(t), ' ', '') AS x FROM n)),
    s AS (SELECT a, b, 2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) AS dice FROM q JOIN x ON x.t = a JOIN x y ON y.t = b) SELECT a, b, round(dice, 9) AS dice FROM s WHERE dice >= 0.85 - 1e-12""")
def c6_dice(spark, sf):
    """All names alike by their pairs of letters."""
    found = similarity.similar_sets(names(spark, sf), "t", T.bigrams(T.squashed(F.col("t"))), 0.85, "dice")
    return found.select("a", "b", F.round("similarity", 9).alias("dice"))


@query(f"WITH {_NAMES}, s AS (SELECT a, b, 1 - levenshtein(lower(a), lower(b))::DOUBLE / greatest(length(a), length(b)) AS similarity FROM q) SELECT a, b, round(similarity, 9) AS similarity FROM s WHERE similarity >= 0.85")
def c12_edit_similarity(spark, sf):
    """All names that few edits part."""
    own = names(spark, sf).select(F.col("t").alias("title"), F.lit(0).alias("pos"))
    found = similarity.similar_texts(own.select("title"), own, 0.85).filter("title < near")
    return found.select(F.col("title").alias("a"), F.col("near").alias("b"), F.round("similarity", 9).alias("similarity"))


@query(f"""WITH {_NAMES}, s AS (SELECT a, b, len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS jaccard FROM q)
    SELECT a, b, round(jaccard, 9) AS jaccard FROM s WHERE jaccard >= 0.6""")
def u5_token_jaccard(spark, sf):
    """All names alike by their words."""
    found = similarity.similar_sets(names(spark, sf), "t", F.split("t", " "), 0.6)
    return found.select("a", "b", F.round("similarity", 9).alias("jaccard"))


@query("""WITH n AS (SELECT p_name || ' ' || (p_size % 12) AS title, min(p_partkey) AS pos FROM part GROUP BY 1),
    s AS (SELECT n.title, o.title AS near, o.pos, 1 - levenshtein(lower(n.title), lower(o.title))::DOUBLE / greatest(length(n.title), length(o.title)) AS similarity FROM n JOIN n o ON n.title <> o.title)
    SELECT title, near, round(similarity, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY similarity DESC, pos) AS k FROM s WHERE similarity >= 0.85) WHERE k = 1""")
def j17_title_conflicts(spark, sf):
    """The other title nearest to each one, from 0.85 on."""
    title = F.concat("p_name", F.lit(" "), (F.col("p_size") % 12).cast("string"))
    n = table(spark, sf, "part").groupBy(title.alias("title")).agg(F.min("p_partkey").alias("pos"))
    return library.title_conflicts(n.select("title"), n).withColumn("similarity", F.round("similarity", 9))


@query("""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS segment, regexp_extract(url, '([^/\\\\]*)$', 1) AS base FROM pages""")
def c22_c29_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_segment(F.col("url")).alias("segment"), T.base_name(F.col("url")).alias("base"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s >= 3600 THEN format('{:d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{:d}:{:02d}', s // 60, s % 60) END AS clock
    FROM (SELECT *, floor(l_quantity * 97)::BIGINT AS s FROM lineitem)""")
def c25_clock(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.clock(F.col("l_quantity") * 97).alias("clock"))


@query("""SELECT event_id, CASE WHEN v >= 0.8 THEN 'high' WHEN v >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM (SELECT event_id, value / 100 AS v FROM events)""")
def c24_confidence_band(spark, sf):
    return table(spark, sf, "events").select("event_id", T.confidence_band(F.col("value") / 100).alias("band"))


@query("""WITH e AS (SELECT event_id, ts AS t, TIMESTAMP '2024-03-01 12:00:00' + INTERVAL 1 MINUTE * (event_id % 50000 - 100) AS seen, CASE WHEN event_id % 11 > 0 THEN value END AS v FROM events),
    a AS (SELECT *, TIMESTAMP '2024-03-01 12:00:00' + INTERVAL 1 MINUTE * 40000 AS now FROM e), d AS (SELECT *, date_diff('day', seen::DATE, now::DATE) AS days, date_diff('minute', seen, now) AS m FROM a),
    r AS (SELECT *, CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN strftime(seen, '%a') WHEN year(seen) = year(now) THEN strftime(seen, '%b %-d') ELSE strftime(seen, '%b %-d, %Y') END AS day FROM d)
    SELECT event_id, day, CASE WHEN m < 1 THEN 'just now' WHEN m = 1 THEN '1 minute ago' WHEN m < 60 THEN m || ' minutes ago' WHEN m < 120 THEN '1 hour ago' WHEN m < 1440 THEN (m // 60) || ' hours ago' ELSE day END AS age,
      CASE WHEN v IS NULL THEN '—' WHEN floor(v * 97 / 60 + 0.5) >= 60 THEN (floor(v * 97 / 60 + 0.5)::BIGINT // 60) || 'h ' || (floor(v * 97 / 60 + 0.5)::BIGINT % 60) || 'm' ELSE floor(v * 97 / 60 + 0.5)::BIGINT || 'm' END AS length,
      CASE WHEN v IS NULL THEN '—' ELSE format('{:,}', event_id * 37) END AS words FROM r""")
def c25_ages(spark, sf):
    """Days, ages, lengths and counts as they are shown."""
    n = F.col("event_id")
    start = F.to_timestamp(F.lit("2024-03-01 12:00:00"))
    at, now = F.timestamp_seconds(F.unix_seconds(start) + 60 * (n % 50000 - 100)), F.timestamp_seconds(F.unix_seconds(start) + 60 * 40000)
    v = F.when(n % 11 > 0, F.col("value"))
    return table(spark, sf, "events").select("event_id", T.relative_day(at, now).alias("day"), T.age_text(at, now).alias("age"), T.hours_minutes(v * 97).alias("length"), T.count_text(F.when(v.isNotNull(), n * 37)).alias("words"))


@query("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'Track ' || (p_size % 9 + 1) ELSE replace(p_name, ' ', '.') || '.v' || p_size END AS title,
      CASE WHEN p_size % 6 = 0 THEN '' ELSE 'mp3' END AS ending, CASE WHEN p_size % 6 = 0 THEN '' ELSE replace(p_name, ' ', '.') || '.v' || p_size || '.MP3' END AS name FROM part""")
def c23_c29_file_names(spark, sf):
    """Base names, ends and titles of sound files; a file without a name is its track's number."""
    path = F.when(F.col("p_size") % 6 == 0, "").otherwise(F.concat(F.lit("/a.b/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".v"), F.col("p_size").cast("string"), F.lit(".MP3")))
    return table(spark, sf, "part").select("p_partkey", T.audio_title(path, F.col("p_size") % 9).alias("title"), T.extension(path).alias("ending"), T.base_name(path).alias("name"))


@query("""SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'idiot')""")
def f9_search(spark, sf):
    """Library search over two columns."""
    return library.search(table(spark, sf, "documents"), " Idiot ", ["text", "source"]).select("doc_id")


@query("""SELECT lang, regexp_matches(lang, '^[a-z]{2,3}$') AS valid, count(*) AS n FROM documents GROUP BY ALL""")
def f18_language_codes(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", F.col("lang").rlike("^[a-z]{2,3}$").alias("valid")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, left(text, 240) AS preview FROM documents""")
def o8_previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(240)).alias("preview"))


@query(None)
def j7_transcript_matches(spark, sf):
    """For each book, the three chapters whose head is most like the transcript (its second chapter's head)."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), T.alignment_text(F.col("text")).alias("body"))
    heard = rows.filter("pos = 1").select("book", F.col("body").alias("transcript"))
    found = alignment.decided(alignment.transcript_matches(heard, rows, "book", "pos"), "book")
    return found.select("book", "pos", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"), "verdict")


@query(None)
def j8_j9_other_sides(spark, sf):
    """The chapter whose whole text, and the later one whose end, is most like the transcript (no SQL twin: probes and scores)."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), T.alignment_text(F.col("text")).alias("body"))
    heard = rows.filter("pos = 2").select("book", F.col("body").alias("transcript"))
    found = [
        alignment.decided(alignment.transcript_matches(heard, rows, "book", "pos", side, after=F.col("pos") > least), "book").withColumn("side", F.lit(side))
        for side, least in (("body", -1), ("tail", 0))
    ]
    return found[0].unionByName(found[1]).select("book", "side", "pos", F.round("score", 6).alias("score"), "verdict")


@query(None)
def p11_p12_detection(spark, sf):
    """Where each book's recording starts and ends: titles, else transcripts of its ends or of each track's head (no SQL twin: scores)."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("book"), "turn", T.alignment_text(F.col("text")).alias("body"))
    rows = rows.withColumn("pos", (F.row_number().over(Window.partitionBy("book").orderBy("turn", "body")) - 1).cast("long"))
    chapters = rows.select("book", "pos", F.left("body", F.lit(24)).alias("title"), "body")
    heard = rows.filter("pos % 2 = 0 AND (pos = 0 OR book % 3 > 0)").select(
        "book", F.expr("pos div 2").alias("track"), F.when(F.col("book") % 5 == 0, F.left("body", F.lit(24))).alias("title"), F.left("body", F.lit(120)).alias("head"),
        F.right("body", F.lit(120)).alias("tail"),
    )
    found = detection.detected(heard, chapters, "book")
    return found.withColumns({"confidence": F.round("confidence", 6), "starts": F.array_join(F.transform("starts", lambda x: F.concat(x["track"], F.lit(":"), x["pos"])), ",")})
