"""Project documents: one JSON file per project, read with defaults for what older files lack, written by keyed upserts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = """schema_version int, join_key string, title string, language string, authors array<string>, cursor long, confirmed_at timestamp,
    receipts array<struct<chapter_index: long, track_index: long, lesson_id: long, degraded: boolean, uploaded_at: timestamp>>,
    skipped array<long>, cover_use boolean, updated_at timestamp, completed_lesson_ids array<long>, cover_path string,
    series struct<name: string, position: double>, collection_id long, last_activity_at timestamp,
    matcher_decision struct<condition: string, response: string>, sources struct<audio: struct<kind: string, paths: array<string>>,
    chapter_manifest: struct<chapters: array<struct<title: string>>>>, _corrupt string"""


def read_projects(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """All project files; health is ok or corrupt, missing fields have their defaults; with ``places`` also path and time of the last change."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    raw = raw.withColumns({"path": F.col("_metadata.file_path"), "modified": F.col("_metadata.file_modification_time")}) if places else raw
    empty = F.expr("from_json('[]', 'array<struct<chapter_index: bigint, track_index: bigint, lesson_id: bigint, degraded: boolean, uploaded_at: timestamp>>')")
    health = F.when(F.col("_corrupt").isNotNull() | F.col("join_key").isNull(), "corrupt").otherwise("ok")
    return raw.withColumns({
        "health": health, "schema_version": F.coalesce("schema_version", F.lit(1)), "cursor": F.coalesce("cursor", F.lit(0).cast("long")),
        "receipts": F.coalesce("receipts", empty), "skipped": F.coalesce("skipped", F.array().cast("array<bigint>")), "cover_use": F.coalesce("cover_use", F.lit(True)),
    })


#: Folder of trashed projects, which a scan leaves out.
TRASH = ".trash"


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """Every project file below ``path`` but the trash's, with its class: ok, corrupt, or deduped where a fresher file (of two of one time
    the first by path) has its key."""
    rows = read_projects(spark, path, places=True).filter(~F.col("path").contains(f"/{TRASH}/"))
    fresh = F.row_number().over(Window.partitionBy("join_key", F.col("health") == "ok").orderBy(F.desc("modified"), "path"))
    return rows.withColumn("class", F.when((F.col("health") == "ok") & (fresh > 1), "deduped").otherwise(F.col("health")))


def health(rows: DataFrame) -> DataFrame:
    """(class, files) of a scan."""
    return rows.groupBy("class").agg(F.count("*").alias("files"))


def trash_entries(spark: SparkSession, path: str) -> DataFrame:
    """Trashed projects that can be read, the latest first: slot, join_key, title, language, trashed_at; none where there is no trash."""
    try:
        rows = read_projects(spark, f"{path.rstrip('/')}/{TRASH}", places=True).filter(F.col("health") == "ok")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], "path string, join_key string, title string, language string, modified timestamp")
    slot = F.regexp_extract("path", rf"/\{TRASH}/([^/]+)/", 1)
    return rows.select(slot.alias("slot"), "join_key", "title", "language", F.col("modified").alias("trashed_at")).orderBy(F.desc("trashed_at"), "slot")


def summaries(projects: DataFrame) -> DataFrame:
    """One row per project that can be read, for lists: counts for what is long, flags for what is there.

    A project without receipts has no degraded one; without a manifest its length is null; a null list has no members.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias
    last = F.try_element_at("receipts", F.lit(-1))["degraded"]
    return projects.filter("health = 'ok'").select(
        F.col("join_key").alias("project"), "title", "language", size("receipts")("receipt_count"), size("completed_lesson_ids")("completed_lesson_count"), "cover_path",
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "series", "collection_id", "last_activity_at", "cursor",
        F.col("matcher_decision").isNotNull().alias("has_matcher_decision"), F.col("sources.audio").isNotNull().alias("has_audio_source"),
        F.coalesce(last, F.lit(False)).alias("last_receipt_degraded"),
        F.when(F.col("sources.chapter_manifest").isNotNull(), F.size("sources.chapter_manifest.chapters")).alias("chapter_manifest_len"), "confirmed_at",
    )


def upserted(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The table after the changes: the latest row of every key; a change among equals wins."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("_new", key)]
    last = F.max_by(F.struct(*columns), F.struct(F.col(order), "_new")).alias("_r")
    return both.groupBy(key).agg(last).select(key, *[f"_r.{c}" for c in columns])


def write_index(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones and return its path; readers take the version they are given."""
    version = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.json(version)
    return version


def patched_receipts(receipts: Column, index: Column, lesson_id: Column) -> Column:
    """The receipts with the lesson of one slot set."""
    return F.transform(receipts, lambda x, i: F.when(i == index, x.withField("lesson_id", lesson_id)).otherwise(x))


def patches(projects: DataFrame, asked: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(projects with the slots set, refused requests with their error) for requests (key, seq, index, lesson_id).

    A slot that does not exist is refused, and so is a project that does not; of several requests for one slot the last one (by seq) is kept.
    """
    sizes = projects.select(key, F.size("receipts").alias("_n"))
    known = asked.join(sizes, key, "left")
    out = F.col("index").isNull() | (F.col("index") < 0) | (F.col("index") >= F.col("_n"))
    error = F.when(F.col("_n").isNull(), "not found").when(out, F.concat(F.lit("no slot "), F.coalesce(F.col("index").cast("string"), F.lit("null")), F.lit(" of "), F.col("_n").cast("string")))
    known = known.withColumn("error", error)
    last = known.filter("error is null").groupBy(key, "index").agg(F.max_by("lesson_id", "seq").alias("lesson_id"))
    slots = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("index").cast("int"), "lesson_id"))).alias("_set"))  # one project's slots
    done = F.transform("receipts", lambda x, i: F.when(F.map_contains_key("_set", i), x.withField("lesson_id", F.col("_set")[i])).otherwise(x))
    rows = projects.join(slots, key, "left").withColumn("receipts", F.when(F.col("_set").isNull(), F.col("receipts")).otherwise(done)).drop("_set")
    return rows, known.filter("error is not null").select(*asked.columns, "error")
