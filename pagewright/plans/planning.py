"""Steps of upload plans, on the stand-ins of the matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import matching as M
from pagewright.operators import planning as P
from pagewright.plans.matching import _CHAPTERS, _TRACKS, a1_count_classify, chapters, tracks
from pagewright.plans.registry import ORACLE_SQL, query


def decided_steps(spark, sf):
    """The chapters, and the steps of every book under the response chosen beforehand, without their bodies."""
    c, t = chapters(spark, sf), tracks(spark, sf)
    response = F.when(F.col("condition").isNull(), "pair_drop").otherwise(F.col("preselect"))
    decisions = a1_count_classify(spark, sf).select("book", response.alias("response"))
    own = t.join(c.select("book").distinct(), "book", "left_semi")
    return c, P.plan_steps(c, own, decisions, "book", "pos", "turn", "chars", "seconds")


@query(f"""WITH {_CHAPTERS}, {_TRACKS},
    k AS (SELECT book, chapters AS nc, tracks AS nt, CASE WHEN condition IS NULL THEN 'pair_drop' ELSE preselect END AS response FROM ({ORACLE_SQL["a1_count_classify"]})),
    w AS (SELECT * FROM ({ORACLE_SQL["w5_proportional_pack"]})), base AS (SELECT book, max(turn) + 1 AS base FROM c GROUP BY book),
    s AS (SELECT book, 0 AS chapter_index, 0 AS track, true AS degraded, 0 AS first_chapter, nc AS end_chapter FROM k WHERE response = 'single_lesson' AND nt > 0
      UNION ALL SELECT book, turn, pos, false, pos, pos + 1 FROM c JOIN k USING (book) WHERE response = 'pair_accept' OR (response = 'pair_drop' AND pos < nt)
      UNION ALL SELECT book, base + pos - nc, pos, true, 0, 0 FROM t JOIN k USING (book) JOIN base USING (book) WHERE response = 'pair_accept' AND pos >= nc
      UNION ALL SELECT book, track, track, first_chapter = end_chapter, first_chapter, end_chapter FROM w JOIN k USING (book) WHERE response = 'split_proportional')
    SELECT s.book, chapter_index::BIGINT AS chapter_index, track::BIGINT AS track, degraded, count(c.pos) AS chapters,
      md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY c.pos), ' ')) AS body_md5
    FROM s LEFT JOIN c ON c.book = s.book AND c.pos >= first_chapter AND c.pos < end_chapter GROUP BY s.book, chapter_index, track, degraded, first_chapter, end_chapter""")
def p6_decided_plan(spark, sf):
    """Steps of every book under the response chosen beforehand (equal counts: pairs)."""
    c, steps = decided_steps(spark, sf)
    return P.with_bodies(steps, c, "book", "pos", "text").select("book", "chapter_index", "track", "degraded", "chapters", F.md5("body").alias("body_md5"))


@query(f"""SELECT book, CASE WHEN tracks = 0 THEN 'a split needs chapters and tracks' END AS error FROM ({ORACLE_SQL["a1_count_classify"]}) WHERE tracks = 0""")
def p6_plan_errors(spark, sf):
    """Books that a proportional split would refuse."""
    c, t = chapters(spark, sf), tracks(spark, sf)
    decisions = c.select("book").distinct().withColumn("response", F.lit("split_proportional"))
    return P.plan_errors(c, t, decisions, "book", "turn")
