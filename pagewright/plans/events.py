"""Event streams: the events table stands in for the events of jobs, one job per user."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from pagewright.operators import events as E
from pagewright.plans.registry import query, table
from pagewright.streaming.mapping import batched_log

#: Stand-ins for the kinds of job events.
KINDS = {"signup": "started", "purchase": "result", "view": "stage_changed", "click": "progress", "error": "log"}


def job_events(df):
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return df.select(F.col("user_id").alias("job"), "event_id", "ts", kinds[F.col("event_type")].alias("kind"), F.lit("uploading").alias("stage"), "value")


_CHECKED = """s AS (SELECT user_id AS job, min(event_id) AS s FROM events WHERE event_type = 'signup' GROUP BY 1),
    p AS (SELECT user_id AS job, s, min(event_id) FILTER (event_type = 'purchase' AND event_id > s) AS p FROM events LEFT JOIN s ON user_id = job GROUP BY ALL),
    e AS (SELECT user_id AS job, event_id, event_type, s, p, CASE WHEN s IS NULL OR event_id < s THEN 'waiting' WHEN p IS NULL OR event_id < p THEN 'running' ELSE 'terminal' END AS life
      FROM events LEFT JOIN p ON user_id = job),
    c AS (SELECT job, event_id, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'result' WHEN 'view' THEN 'stage_changed' WHEN 'click' THEN 'progress' ELSE 'log' END AS kind, life,
      CASE WHEN event_type = 'signup' THEN CASE WHEN event_id = s THEN NULL WHEN life = 'running' THEN 'duplicate start' ELSE 'start after the end' END
        WHEN event_type = 'purchase' THEN CASE WHEN event_id = p THEN NULL WHEN life = 'waiting' THEN 'end before the start' ELSE 'second end' END
        WHEN life = 'waiting' THEN 'event before the start' WHEN life = 'terminal' THEN 'event after the end' END AS error FROM e)"""


def checked(spark, sf):
    return E.validated(job_events(table(spark, sf, "events")), "job", ["event_id"], "kind", "stage", ["event_id"])


@query(f"WITH {_CHECKED} SELECT job, event_id, kind, error, life FROM c")
def t1_event_validation(spark, sf):
    """Every event with the reason for its rejection, if any, and its job's state."""
    return checked(spark, sf).select("job", "event_id", "kind", "error", "life")


@query(f"WITH {_CHECKED} SELECT job, count(*) AS events, count(error) AS rejected, bool_or(life = 'terminal') AS ended FROM c GROUP BY job")
def t2_sequence_verdicts(spark, sf):
    return E.sequence_verdicts(checked(spark, sf), "job")


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL""")
def t4_latest_rows(spark, sf):
    """Upsert of all events: the last values of every key."""
    return E.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])


@query("""WITH k AS (SELECT user_id, event_type, max(ts) AS fetched, max((SELECT max(ts) FROM events)) AS now FROM events GROUP BY ALL)
    SELECT user_id, event_type, now - fetched >= INTERVAL 15 MINUTE AS stale FROM k""")
def t8_stale_views(spark, sf):
    """Views fetched 15 minutes before the newest event, or earlier."""
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now")).withColumn("one", F.lit(1))
    views = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("fetched")).withColumn("one", F.lit(1)).join(F.broadcast(now), "one")  # one row
    return views.select("user_id", "event_type", (F.col("fetched") + F.expr("INTERVAL 15 MINUTES") <= F.col("now")).alias("stale"))


@query("""SELECT user_id, json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL""")
def s19_lenient_json(spark, sf):
    """First of the alternative keys that a payload has; rows without any are dropped."""
    v = F.try_parse_json("props")
    k = F.coalesce(*[F.try_variant_get(v, p, "bigint") for p in ("$.k", "$.key", "$.n")])
    return table(spark, sf, "events").withColumn("k", k).filter("k IS NOT NULL").groupBy("user_id", "k").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS opened, count(*) AS changes FROM s GROUP BY user_id, n""")
def t7_debounced_batches(spark, sf):
    """Changes that follow each other within a quiet period are one batch."""
    w = F.session_window("ts", "6 hours")
    return table(spark, sf, "events").groupBy("user_id", w.alias("w")).agg(F.min("ts").alias("opened"), F.count("*").alias("changes")).select("user_id", "opened", "changes")


@query("""WITH RECURSIVE g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS MATERIALIZED (SELECT user_id, ts, event_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
    b AS (SELECT user_id, n, min(ts) AS opened FROM s GROUP BY ALL UNION ALL SELECT b.user_id, b.n, min(s.ts) FROM b JOIN s ON s.user_id = b.user_id AND s.n = b.n AND s.ts >= b.opened + INTERVAL 8 HOUR GROUP BY b.user_id, b.n)
    SELECT user_id, opened, count(*) AS changes FROM (SELECT s.user_id, s.event_id, max(b.opened) AS opened FROM s JOIN b ON s.user_id = b.user_id AND s.n = b.n AND b.opened <= s.ts GROUP BY ALL) GROUP BY ALL""")
def t7_longest_wait(spark, sf):
    """Batches that also end a longest wait after they opened."""
    return E.debounced(table(spark, sf, "events"), "user_id", "ts", timedelta(hours=6), timedelta(hours=8))


@query(None)
def t5_t6_mapping_log(spark, sf):
    """An optimistic log of mapping changes (no SQL twin: every change depends on all before it)."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("park", "unpark", "reassign", "swap")]), (F.col("event_id") % 4 + 1).cast("int"))
    nth = F.expr("row_number() over (partition by user_id order by event_id)")
    ops = table(spark, sf, "events").select(
        F.col("user_id").alias("book"), F.col("event_id").alias("seq"), (nth - (F.col("event_id") % 5 == 0).cast("int")).cast("long").alias("expected"),
        kind.alias("kind"), (F.col("event_id") % 8).alias("chapter"), (F.floor(F.col("value")) % 8).cast("long").alias("track"),
    )
    return E.mapping_log(ops, "book", 8)


@query(None)
def t5_t7_batched_log(spark, sf):
    """Mapping changes in batches that end with a pause, a longest wait or their first failure (no SQL twin: every change depends on all before it)."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("park", "unpark", "reassign", "swap")]), (F.col("event_id") % 4 + 1).cast("int"))
    nth = F.expr("row_number() over (partition by user_id order by ts, event_id)")
    ops = table(spark, sf, "events").select(
        F.col("user_id").alias("book"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (nth - F.floor(nth / 4)).cast("long").alias("expected"), kind.alias("kind"),
        (F.col("event_id") % 8).alias("chapter"), (F.floor(F.col("value")) % 8).cast("long").alias("track"),
    )
    return batched_log(ops, 8, timedelta(hours=6), timedelta(hours=8))
