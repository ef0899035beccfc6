"""Mappings and their plans, on the stand-ins of the matching queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagewright.operators import mapping as P
from pagewright.operators import matching as M
from pagewright.plans.matching import _CHAPTERS, _TRACKS, a1_count_classify, chapters, tracks
from pagewright.plans.planning import decided_steps, p6_decided_plan
from pagewright.plans.registry import ORACLE_SQL, query, table

_SKIPS = "turn % 5 = 3"
_UPLOADED = "role = 'assistant' AND turn % 10 = 3"
_ELIGIBLE = f"""e AS (SELECT book, turn, role, text, chars, row_number() OVER (PARTITION BY book ORDER BY turn) - 1 AS pos FROM c WHERE NOT ({_SKIPS}) OR ({_UPLOADED}))"""


def own_chapters(spark, sf):
    """The chapters that count, numbered anew."""
    rows = chapters(spark, sf).drop("pos")
    return M.numbered(P.eligible(rows, rows.filter(_SKIPS), rows.filter(_UPLOADED), "book", "turn"), "book", ["turn"], "pos")


def with_chapters(spark, sf):
    return tracks(spark, sf).join(chapters(spark, sf).select("book").distinct(), "book", "left_semi")


@query(f"WITH {_CHAPTERS}, {_ELIGIBLE} SELECT book, turn, pos FROM e")
def f5_eligible_chapters(spark, sf):
    """Chapters that are not skipped or are uploaded already."""
    return own_chapters(spark, sf).select("book", "turn", "pos")


@query(f"""WITH {_CHAPTERS}, s AS (SELECT book, turn + CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS turn FROM c WHERE {_SKIPS})
    SELECT DISTINCT book, turn FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.book = s.book AND c.turn = s.turn)""")
def j12_orphan_skips(spark, sf):
    """Skips of chapters that are not there."""
    c = chapters(spark, sf)
    moved = (F.col("turn") + F.when(F.col("turn") % 3 == 0, 1).otherwise(0)).cast("long").alias("turn")
    return P.orphans(c.filter(_SKIPS).select("book", moved).distinct(), c, "book", "turn")


_SEEDED = f"""{_CHAPTERS}, {_TRACKS}, k AS (SELECT book, tracks AS nt, CASE WHEN condition IS NULL THEN 'pair_drop' ELSE preselect END AS response FROM ({ORACLE_SQL["a1_count_classify"]})),
    w AS (SELECT * FROM ({ORACLE_SQL["w5_proportional_pack"]})),
    m AS (SELECT c.book, turn, CASE response WHEN 'single_lesson' THEN 0 WHEN 'split_proportional' THEN w.track ELSE CASE WHEN pos < nt THEN pos END END AS track
      FROM c JOIN k USING (book) LEFT JOIN w ON w.book = c.book AND pos >= first_chapter AND pos < end_chapter
      WHERE nt > 0 AND response IN ('single_lesson', 'split_proportional', 'pair_accept', 'pair_drop'))"""


def seeded(spark, sf):
    response = F.when(F.col("condition").isNull(), "pair_drop").otherwise(F.col("preselect"))
    decisions = a1_count_classify(spark, sf).select("book", response.alias("response"))
    return P.seeded(chapters(spark, sf), with_chapters(spark, sf), decisions, "book", "pos", "turn", "chars", "seconds")


@query(f"WITH {_SEEDED} SELECT book, turn, track::BIGINT AS track FROM m")
def p2_seeded_mapping(spark, sf):
    """The mapping that each book's response gives."""
    return seeded(spark, sf).select("book", "turn", "track")


@query(None)
def p2_seeded_by_titles(spark, sf):
    """Pairs by titles where a book has anchors, else by position; the rest follows its anchor, or is dropped (no SQL twin: a fold with scores).

    Brands are books: their parts by name are chapters, by number (without every fifth) tracks.
    """
    part = table(spark, sf, "part").groupBy(F.col("p_brand").alias("book"), F.concat_ws(" ", "p_name", "p_type").alias("title")).agg(F.min("p_partkey").alias("n"), F.sum("p_size").alias("chars"))
    c = M.numbered(part, "book", ["title"], "pos").withColumn("turn", F.col("pos"))
    t = M.numbered(part.filter("n % 5 > 0"), "book", ["n"], "pos").withColumn("seconds", F.col("chars").cast("double"))
    decisions = part.select("book").distinct().withColumn("response", F.when(F.col("book").endswith("1"), "pair_drop").otherwise("pair_accept"))
    anchors = M.title_anchors(c, t, "book", "pos", "title")
    return P.seeded(c, t, decisions, "book", "pos", "turn", "chars", "seconds", anchors).select("book", "turn", "track")


@query(f"""WITH {_SEEDED} SELECT book, pos, l_partkey FROM t WHERE book IN (SELECT book FROM m) AND NOT EXISTS (SELECT 1 FROM m WHERE m.book = t.book AND m.track = t.pos)""")
def j24_parked_tracks(spark, sf):
    """Tracks that the seeded mapping leaves over."""
    m = seeded(spark, sf)
    return P.parked(tracks(spark, sf).join(m.select("book"), "book", "left_semi"), m, "book", "pos").select("book", "pos", "l_partkey")


_SLICE = "x.conv_id = conversations.conv_id AND x.role = 'assistant' AND trim(x.text, ' ') <> ''"
_BOUNDED = ORACLE_SQL["w5_proportional_pack"].replace(
    "WHERE trim(text, ' ') <> ''",
    f"WHERE trim(text, ' ') <> '' AND turn >= (SELECT min(x.turn) FROM conversations x WHERE {_SLICE}) AND turn <= (SELECT max(x.turn) FROM conversations x WHERE {_SLICE})",
)


@query(f"""WITH {_CHAPTERS}, b AS (SELECT book, min(turn) FILTER (role = 'assistant') AS lo, max(turn) FILTER (role = 'assistant') AS hi FROM c GROUP BY book),
    s AS (SELECT book, turn, row_number() OVER (PARTITION BY book ORDER BY turn) - 1 AS pos FROM c JOIN b USING (book) WHERE turn BETWEEN lo AND hi),
    w AS (SELECT * FROM ({_BOUNDED}))
    SELECT s.book, turn, track::BIGINT AS track FROM s LEFT JOIN w ON w.book = s.book AND pos >= first_chapter AND pos < end_chapter WHERE s.book IN (SELECT l_orderkey FROM lineitem)""")
def p3_bounded_mapping(spark, sf):
    """Proportional ranges over the slice between two chapters."""
    c, only = chapters(spark, sf), F.when(F.col("role") == "assistant", F.col("turn"))
    ends = c.groupBy("book").agg(F.min(only).alias("lo"), F.max(only).alias("hi"))
    cut = M.numbered(c.drop("pos").join(ends, "book").filter("turn BETWEEN lo AND hi"), "book", ["turn"], "pos")
    t = tracks(spark, sf)
    ranges = M.proportional_pack(cut, t.join(cut.select("book"), "book", "left_semi"), "book", "pos", "chars", "seconds")
    return P.by_ranges(cut.join(t.select("book"), "book", "left_semi"), ranges, "book", "pos", "turn")


_STARTS = f"""{_CHAPTERS}, {_TRACKS}, n AS (SELECT book, count(*) AS chapters FROM c GROUP BY book),
    st AS (SELECT book, pos - pos % 2 AS track, l_partkey % 12 AS turn, pos AS seq FROM t WHERE l_partkey % 3 = 0),
    l AS (SELECT book, track, arg_max(turn, seq) AS turn FROM st GROUP BY ALL),
    a AS (SELECT t.book, t.pos, c.pos AS start, chapters FROM t JOIN n USING (book) LEFT JOIN l ON l.book = t.book AND l.track = t.pos LEFT JOIN c ON c.book = l.book AND c.turn = l.turn)"""


def starts(spark, sf):
    rows = tracks(spark, sf).filter("l_partkey % 3 = 0")
    return rows.select("book", (F.col("pos") - F.col("pos") % 2).alias("track"), (F.col("l_partkey") % 12).cast("long").alias("turn"), F.col("pos").alias("seq"))


@query(f"WITH {_STARTS} SELECT book, pos, start, chapters FROM a")
def j25_atom_starts(spark, sf):
    """The last known start of each track as a position."""
    c = chapters(spark, sf).withColumn("turn", F.col("turn").cast("long"))
    return P.atom_starts(starts(spark, sf), c, tracks(spark, sf), "book", "pos", "turn").select("book", "pos", "start", "chapters")


_RANGED = ORACLE_SQL["w6_anchored_ranges"].split("k AS (SELECT *, row_number()", 1)[1].replace("coalesce(first_value(k IGNORE NULLS) OVER x, 8)", "coalesce(first_value(k IGNORE NULLS) OVER x, chapters)").replace(
    "f AS (SELECT book, pos,", "f AS (SELECT book, pos, chapters,").replace("OVER (PARTITION BY book ORDER BY pos), 8)::BIGINT", "OVER (PARTITION BY book ORDER BY pos), chapters)::BIGINT")


@query(f"""WITH {_STARTS}, z AS (WITH k AS (SELECT *, row_number(){_RANGED})
    SELECT c.book, turn, z.pos AS track FROM c LEFT JOIN z ON z.book = c.book AND c.pos >= first_chapter AND c.pos < end_chapter WHERE c.book IN (SELECT book FROM t)""")
def p3_anchored_mapping(spark, sf):
    """Ranges between known openings."""
    c = chapters(spark, sf).withColumn("turn", F.col("turn").cast("long"))
    return P.seeded_by_starts(starts(spark, sf), c, tracks(spark, sf), "book", "pos", "turn")


#: An edited mapping: two chapters a track, some without; in a few books an entry is missing.
_EDITED = """m AS (SELECT book, turn, CASE WHEN turn % 4 <> 2 THEN pos // 2 END AS track FROM c WHERE NOT (book % 11 = 0 AND pos = 1)),
    pk AS (SELECT book, pos FROM t WHERE l_partkey % 6 = 0)"""
_ERRORS = f"""{_CHAPTERS}, {_TRACKS}, {_ELIGIBLE}, {_EDITED},
    x AS (SELECT e.book, e.pos, CASE WHEN m.book IS NULL THEN 'no entry' WHEN m.track IS NOT NULL AND t.book IS NULL THEN 'unknown track' END AS error
      FROM e LEFT JOIN m USING (book, turn) LEFT JOIN t ON t.book = e.book AND t.pos = m.track),
    bad AS (SELECT book, arg_min(error, pos) AS error FROM x WHERE error IS NOT NULL GROUP BY book)"""


def edited(spark, sf):
    c = chapters(spark, sf).filter("NOT (book % 11 = 0 AND pos = 1)")
    mapping = c.select("book", "turn", F.when(F.col("turn") % 4 != 2, F.expr("pos div 2")).alias("track"))
    return mapping, tracks(spark, sf).filter("l_partkey % 6 = 0")


@query(f"WITH {_ERRORS} SELECT book, error FROM bad")
def p5_mapping_errors(spark, sf):
    """Books whose edited mapping does not fit their chapters or tracks."""
    mapping, _ = edited(spark, sf)
    return P.mapping_errors(own_chapters(spark, sf), tracks(spark, sf), mapping, "book", "pos", "turn")


_PLAN = f"""{_ERRORS}, ok AS (SELECT DISTINCT book FROM m WHERE book NOT IN (SELECT book FROM bad)),
    r AS (SELECT e.*, m.track, CASE WHEN row_number() OVER v = 1 OR m.track IS DISTINCT FROM lag(m.track) OVER v THEN 1 ELSE 0 END AS fresh FROM e JOIN m USING (book, turn) JOIN ok USING (book)
      WINDOW v AS (PARTITION BY e.book ORDER BY e.pos)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY book ORDER BY pos) AS run FROM r),
    base AS (SELECT book, max(turn) + 1 AS base FROM c GROUP BY book),
    plan AS (SELECT book, min(turn)::BIGINT AS chapter_index, track::BIGINT AS track, false AS degraded, count(*) AS chapters, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS body_md5
        FROM i WHERE track IS NOT NULL GROUP BY book, run, track
      UNION ALL SELECT book, (base + pos)::BIGINT, pos::BIGINT, true, 0, md5(' ') FROM t JOIN ok USING (book) JOIN base USING (book)
        WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.book = t.book AND m.track = t.pos) AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.book = t.book AND pk.pos = t.pos))"""


def edited_plan(spark, sf):
    mapping, parking = edited(spark, sf)
    steps = P.plan_of(mapping, parking, own_chapters(spark, sf), chapters(spark, sf), tracks(spark, sf), "book", "pos", "turn", "text")
    return steps.select("book", "chapter_index", "track", "degraded", "chapters", F.md5("body").alias("body_md5"))


@query(f"WITH {_PLAN} SELECT * FROM plan")
def p5_edited_plan(spark, sf):
    """Steps of an edited mapping."""
    return edited_plan(spark, sf)


_KINDS = f"""kk AS (SELECT book, book % 3 = 0 AS mapping, book % 3 = 1 AS decision, condition IS NULL AS pairs FROM ({ORACLE_SQL["a1_count_classify"]})),
    kind AS (SELECT book, CASE WHEN mapping THEN 'mapping' WHEN decision THEN 'decision' WHEN pairs THEN 'pairs' END AS kind FROM kk),
    steps AS (SELECT plan.*, kind FROM plan JOIN kind USING (book) WHERE kind = 'mapping' UNION ALL SELECT d.*, kind FROM ({ORACLE_SQL["p6_decided_plan"]}) d JOIN kind USING (book) WHERE kind IN ('decision', 'pairs'))"""


def prioritised(spark, sf, bodies: bool = True):
    """Kinds of plan that each book has, and its steps by the first kind; without bodies, each book's counts of its steps."""
    decided, own = p6_decided_plan(spark, sf) if bodies else decided_steps(spark, sf)[1], edited_plan(spark, sf)
    if not bodies:
        counts = lambda df: df.groupBy("book").agg(F.count("*").alias("steps"), F.count_if("degraded").alias("degraded"))
        decided, own = counts(decided), counts(own)
    kinds = a1_count_classify(spark, sf).select("book", (F.col("book") % 3 == 0).alias("mapping"), (F.col("book") % 3 == 1).alias("decision"), F.col("condition").isNull().alias("pairs"))
    return kinds, P.chosen_plan(kinds, {"mapping": own, "decision": decided, "pairs": decided}, "book")


@query(f"WITH {_PLAN}, {_KINDS} SELECT book, chapter_index, track, degraded, chapters, body_md5, kind FROM steps")
def p4_prioritised_plan(spark, sf):
    """A mapping goes before a decision, a decision before pairs of equal counts."""
    return prioritised(spark, sf)[1]


@query(f"WITH {_PLAN}, {_KINDS} SELECT kk.book, count(steps.book) AS steps, count(*) FILTER (degraded) AS degraded FROM kk LEFT JOIN steps USING (book) GROUP BY kk.book")
def p7_preview(spark, sf):
    """How many steps a start would make; none for books that wait for a decision."""
    kinds, steps = prioritised(spark, sf, bodies=False)
    counts = steps.groupBy("book").agg(F.sum("steps").alias("steps"), F.sum("degraded").alias("degraded"))
    return kinds.select("book").join(counts, "book", "left").fillna(0, ["steps", "degraded"])


@query(f"""SELECT book, CASE WHEN condition IS NULL THEN 'pairs' ELSE 'mismatch' END AS outcome, CASE WHEN book % 3 <> 1 THEN condition END AS inspected,
    CASE WHEN book % 3 <> 1 AND condition IS NOT NULL THEN options END AS options FROM ({ORACLE_SQL["a1_count_classify"]})""")
def p1_p8_match_and_inspection(spark, sf):
    """What the automatic match finds, and what there is to look at: nothing once decided, nothing where counts agree."""
    rows, decided = a1_count_classify(spark, sf), F.col("book") % 3 == 1
    open_ = ~decided & F.col("condition").isNotNull()
    return rows.select("book", F.when(F.col("condition").isNull(), "pairs").otherwise("mismatch").alias("outcome"), F.when(open_, F.col("condition")).alias("inspected"), F.when(open_, F.col("options")).alias("options"))


_PAIRS = f"{_CHAPTERS}, {_TRACKS}, q AS (SELECT c.book, c.pos, turn, turn % 7 = 0 AS touched, l_partkey, (seconds - 1) / 49 AS sure FROM c LEFT JOIN t ON t.book = c.book AND t.pos = c.pos)"
_OPEN = "NOT (touched OR l_partkey IS NULL OR coalesce(sure >= 0.6, false))"


@query(f"WITH {_PAIRS} SELECT book, bool_and(NOT ({_OPEN})) AS ready, count(*) FILTER ({_OPEN}) AS blocking FROM q GROUP BY book")
def f14_f15_score_gate(spark, sf):
    """Whether a book may start, and how many pairs stand in the way."""
    rows = M.positional_pairs(chapters(spark, sf), tracks(spark, sf), "book", equal_only=False)
    settled = P.is_settled(F.col("turn") % 7 == 0, F.col("l_partkey"), (F.col("seconds") - 1) / 49)
    return rows.withColumn("_s", settled).groupBy("book").agg(F.bool_and("_s").alias("ready"), F.count_if(~F.col("_s")).alias("blocking"))


@query(f"""WITH {_PAIRS} SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) AS number, turn, l_partkey FROM q WHERE NOT ({_SKIPS})""")
def j19_pairs_of_chapters(spark, sf):
    """Pairs in chapter order, numbered from 1 without the skipped ones."""
    rows = M.positional_pairs(chapters(spark, sf), tracks(spark, sf), "book", equal_only=False).filter(f"NOT ({_SKIPS})")
    return M.numbered(rows, "book", ["pos"], "number").select("book", (F.col("number") + 1).alias("number"), "turn", "l_partkey")


@query(f"WITH {_CHAPTERS} SELECT book, turn, pos, role, chars FROM c")
def f2_chapter_meta(spark, sf):
    """Chapters without their bodies."""
    return chapters(spark, sf).select("book", "turn", "pos", "role", "chars")


@query(f"""WITH {_CHAPTERS}, v AS (SELECT book, CASE WHEN book % 2 = 0 THEN min(turn) END AS cover FROM c GROUP BY book) SELECT book, turn, pos FROM c JOIN v USING (book) WHERE cover IS NULL OR turn <> cover""")
def f4_cover_filter(spark, sf):
    """Chapters but the one that is the cover page; numbers stay."""
    c = chapters(spark, sf)
    cover = c.groupBy("book").agg(F.when(F.col("book") % 2 == 0, F.min("turn")).alias("cover"))
    return c.join(cover, "book").filter("cover IS NULL OR turn <> cover").select("book", "turn", "pos")


@query(f"""SELECT book, condition, eligible, eligible AND book % 2 = 0 AND book % 3 <> 0 AND book % 7 <> 0 AS available FROM
    (SELECT book, condition, chapters > tracks AND tracks > 0 AND coalesce(condition IN ('many_to_few', 'many_to_one', 'unalignable'), false) AS eligible FROM ({ORACLE_SQL["a1_count_classify"]}))""")
def f16_f17_detection_flags(spark, sf):
    """Whether a book's range can be detected, and whether a service may be asked (key, consent, no evidence yet)."""
    kinds = F.coalesce(F.col("condition").isin("many_to_few", "many_to_one", "unalignable"), F.lit(False))
    eligible = (F.col("chapters") > F.col("tracks")) & (F.col("tracks") > 0) & kinds
    book = F.col("book")
    return a1_count_classify(spark, sf).select("book", "condition", eligible.alias("eligible"), (eligible & (book % 2 == 0) & (book % 3 != 0) & (book % 7 != 0)).alias("available"))


_BANDS = f"{_PAIRS}, n AS (SELECT book, max(pos) + 1 AS n FROM q GROUP BY book), d AS (SELECT *, pos // 3 AS band, pos % 3 AS nth, n FROM q JOIN n USING (book))"


@query(f"""WITH {_BANDS} SELECT book, turn, band, band > 0 AND nth = 0 AS may_go_back, pos + 1 < n AND nth = 2 AS may_go_on FROM d""")
def w18_edge_moves(spark, sf):
    """Only the first row of a band may move to the band before, only the last to the band after."""
    w = Window.partitionBy("book").orderBy("pos")
    rows = chapters(spark, sf).withColumn("band", F.expr("pos div 3"))
    edge = lambda c: F.coalesce(c.over(w) != F.col("band"), F.lit(False))
    return rows.select("book", "turn", "band", edge(F.lag("band")).alias("may_go_back"), edge(F.lead("band")).alias("may_go_on"))


@query(f"""WITH {_TRACKS} SELECT book, pos, l_linenumber, row_number() OVER (PARTITION BY book ORDER BY l_linenumber DESC, pos) - 1 AS place FROM t""")
def w12_running_order(spark, sf):
    """One numbering of tracks across files: by file, then by place in it."""
    return M.numbered(tracks(spark, sf), "book", [F.desc("l_linenumber"), "pos"], "place").select("book", "pos", "l_linenumber", "place")
