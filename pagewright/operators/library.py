"""The library: summaries, status, order, search, de-duplication, grouping of candidates, conflicts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import normal_form
from pagewright.operators.similarity import similar_texts

#: States in the order in which a library shows them.
STATUS_ORDER = ("running", "needs_match", "paused", "done", "failed", "idle")


def status(running: Column, confirmed: Column, receipts: Column, cursor: Column, total: Column, last_degraded: Column) -> Column:
    """running, needs_match, failed, done, paused or idle, the first that applies."""
    bad = F.coalesce(last_degraded, F.lit(False))
    return (
        F.when(running, "running")
        .when(~confirmed & (receipts == 0), "needs_match")
        .when(bad & (cursor < total), "failed")
        .when((total > 0) & (cursor >= total) & ~bad, "done")
        .when((receipts > 0) & (cursor < total), "paused")
        .otherwise("idle")
    )


def status_reason(state: Column, last_chapter: Column) -> Column:
    """Why a project failed: the chapter of its last receipt; null for any other state."""
    return F.when(state == "failed", F.concat(F.lit("stopped at chapter "), F.coalesce(last_chapter, F.lit(0)).cast("string")))


def is_pending(receipts: Column, unfinished: Column, cursor: Column, completed: Column, decided: Column) -> Column:
    """A receipt without a lesson, a cursor before the last receipt, or a decision with nothing done yet."""
    return (unfinished > 0) | (cursor < receipts) | ((receipts == 0) & (completed == 0) & decided)


def freshest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def search(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows with the needle, composed and in lower case, in any of the columns; an empty needle finds all."""
    hay = F.lower(normal_form("NFC")(F.concat_ws(" ", *columns)))
    return df.filter(hay.contains(unicodedata.normalize("NFC", needle).strip().lower()))


def localised(title: Column) -> Column:
    """A title that compares as readers sort it: letters before accents before case."""
    return F.collate(title, "UNICODE")


def library_order(rank: Column, activity: Column, title: Column, done: Column) -> list[Column]:
    """Status rank, then the latest activity of what is done (nulls last), then the title as readers sort it."""
    return [rank.asc(), F.when(done, activity).desc_nulls_last(), localised(title).asc()]


def title_bins(df: DataFrame, title: str, bins: int = 64) -> Column:
    """How many of at most ``bins`` titles, drawn by their hash, are before a title in the readers' order: coarse places for ``places``.

    A bin has about rows / bins rows but for titles that repeat.
    """
    drawn = df.filter(F.col(title).isNotNull()).select(F.col(title).alias("t")).distinct().orderBy(F.xxhash64("t")).limit(bins).collect()
    return F.size(F.filter(F.array(*[F.lit(r.t) for r in drawn]).cast("array<string>"), lambda x: localised(x) < localised(F.col(title))))


def title_conflicts(new: DataFrame, old: DataFrame, least: float = 0.85) -> DataFrame:
    """(title, near, similarity): the most similar other existing title of each new one, the first in order among equals.

    Titles are met by shared pieces, never all against all (``similar_texts``).
    """
    return freshest(similar_texts(new, old, least), ["title"], [F.desc("similarity"), "pos"]).select("title", "near", "similarity")


def candidate_groups(df: DataFrame, partition: str, position: str, keys: list[str]) -> DataFrame:
    """(position, leader): each candidate joins the first group whose head shares a key with it, else heads a new one.

    Order decides and sharing is not transitive, so this is a fold in position order; ``partition`` must hold together
    all candidates that can share a key (such as a normalised title's hash). Candidates with equal keys share a leader, so
    the fold sees only the first of each; candidates without any key head a group of their own.
    """
    own_keys = [F.nanvl(k, F.lit(None)) if t in ("float", "double") else F.col(k) for k, t in df.select(*keys).dtypes]
    rows = df.select(F.col(partition).alias("_p"), F.col(position).alias("_at"), *[c.alias(k) for c, k in zip(own_keys, keys, strict=True)])
    keyless = F.lit(True)
    for k in keys:
        keyless = keyless & F.col(k).isNull()
    keyed = rows.filter(~keyless).withColumn("_id", F.to_json(F.struct("_p", *keys)))
    first = keyed.groupBy("_p", "_id", *keys).agg(F.min("_at").alias("_first"))

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        heads: dict[tuple, int] = {}  # (key column, value) of heads -> order of the group
        leaders: list[int] = []
        out = []
        for row in pdf.rename(columns={"_first": "first", "_id": "id"}).sort_values("first").itertuples(index=False):
            own = [(k, getattr(row, k)) for k in keys if getattr(row, k) is not None and getattr(row, k) == getattr(row, k)]
            found = min((heads[x] for x in own if x in heads), default=None)
            if found is None:
                found = len(leaders)
                leaders.append(row.first)
                for x in own:
                    heads.setdefault(x, found)
            out.append((row.id, leaders[found]))
        return pd.DataFrame(out, columns=["_id", "leader"])

    leaders = first.groupBy("_p").applyInPandas(fold, "_id string, leader long")
    led = keyed.select("_id", "_at").join(leaders, "_id")
    alone = rows.filter(keyless).select(F.col("_at").cast("long").alias("position"), F.col("_at").cast("long").alias("leader"))
    return led.select(F.col("_at").cast("long").alias("position"), "leader").unionByName(alone)


def reconcile(candidates: DataFrame, store: DataFrame, partition: str, keys: list[str], least: float = 0.85) -> DataFrame:
    """One row for each group of candidates: leader (its position), key, title, members, outcome and near.

    ``candidates`` has position, title and identity keys, the strongest first; ``store`` has the key, title and pos of each project. A group whose
    leader's first key the store has is merged; else a project with a title much like the leader's (or the same) is a conflict with it; else it
    is created. Groups follow the order of candidates (``candidate_groups``), near is the key of the most similar project, the first among equals.
    """
    groups = candidate_groups(candidates, partition, "position", keys)
    leaders = groups.groupBy("leader").agg(F.count("*").alias("members"))
    own = candidates.select(F.col("position").cast("long").alias("leader"), F.coalesce(*keys).alias("key"), "title")
    rows = leaders.join(own, "leader")
    held = rows.join(store.select("key").distinct(), "key", "left_semi").select("leader").withColumn("merged", F.lit(True))
    open_ones = rows.join(held, "leader", "left_anti")
    titles = store.groupBy("title").agg(F.min_by("key", "pos").alias("near_key"), F.min("pos").alias("pos"))
    # a title that the store has as it is, but for its case, is nearer than any other
    lower = titles.groupBy(F.lower("title").alias("_t")).agg(F.min_by("near_key", "pos").alias("same"))
    alike = title_conflicts(open_ones.select("title").distinct(), titles.select("title", "pos"), least)
    alike = alike.join(titles.select(F.col("title").alias("near"), "near_key"), "near").select("title", "near_key")
    found = open_ones.withColumn("_t", F.lower("title")).join(lower, "_t", "left").join(alike, "title", "left").select("leader", F.coalesce("same", "near_key").alias("near"))
    out = rows.join(held, "leader", "left").join(found, "leader", "left")
    outcome = F.when(F.col("merged"), "merged").when(F.col("near").isNotNull(), "conflict").otherwise("created")
    return out.select("leader", "key", "title", "members", outcome.alias("outcome"), "near")


def creations(asked: DataFrame, store: DataFrame, key_of, most: int = 100) -> DataFrame:
    """Adds outcome (created, conflict, replaced, skipped, failed), project (the key) and shown (the title) to requests (seq, title, author, resolution).

    ``key_of(title, author)`` gives a project's key; ``store`` has key and title. A key that is free is created; one that is taken is a conflict
    with the project that has it, unless the request resolves it: replace it, skip, or make a new one under the first of ``most`` titles with `` (copy)`` whose key
    is free. Each request meets the store as it is.
    """
    held = store.select("key", F.col("title").alias("_held")).dropDuplicates(["key"])
    rows = asked.withColumn("key", key_of(F.col("title"), F.col("author"))).join(held, "key", "left")
    taken = F.col("_held").isNotNull()
    # a title's copies are tried once, however many ask for it
    wanted = rows.filter(taken & (F.col("resolution") == "new")).select("title", "author").distinct()
    tries = wanted.select("title", "author", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n"))
    tries = tries.withColumn("copy", F.concat("title", F.repeat(F.lit(" (copy)"), F.col("n")))).withColumn("key", key_of(F.col("copy"), F.col("author")))
    first = tries.join(held, "key", "left_anti").groupBy("title", "author").agg(F.min_by(F.struct("key", "copy"), "n").alias("_c"))
    first = first.select(F.col("title").alias("_title"), F.col("author").alias("_author"), "_c")
    rows = rows.join(first, F.col("title").eqNullSafe(F.col("_title")) & F.col("author").eqNullSafe(F.col("_author")), "left")
    outcome = (
        F.when(~taken, "created").when(F.col("resolution") == "replace", "replaced").when(F.col("resolution") == "skip", "skipped")
        .when((F.col("resolution") == "new") & F.col("_c").isNotNull(), "created").when(F.col("resolution") == "new", "failed").otherwise("conflict")
    )
    copied = taken & (F.col("resolution") == "new")
    project = F.when(copied, F.col("_c.key")).otherwise(F.col("key"))
    shown = F.when(copied, F.col("_c.copy")).when(taken & F.col("resolution").isNull(), F.col("_held")).otherwise(F.col("title"))
    return rows.select(*asked.columns, outcome.alias("outcome"), project.alias("project"), shown.alias("shown"))
