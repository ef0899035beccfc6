"""Job events as streams: stateful validation, the latest row of every key, and windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.events import latest, stateful_validator

STATE = "life string, detection boolean"
OUTPUT = "job long, event_id long, kind string, error string, life string"


def validated_stream(events: DataFrame) -> DataFrame:
    """events has job, event_id, ts, kind and stage; one row out for each, with its error if it is rejected."""
    return events.groupBy("job").applyInPandasWithState(stateful_validator, OUTPUT, STATE, "append", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per kind and window; what comes later than ``late`` is left out."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def upsert_batches(path: str, keys: list[str], order: list[str], columns: list[str]):
    """A foreachBatch writer that leaves one version of the latest rows per batch below ``path``.

    A batch that is run again overwrites its own version, and reads the one of the batch before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(*dict.fromkeys([*keys, *order, *columns]))
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{path}/batch={number - 1}"))
        kept = latest(rows, keys, order, [c for c in rows.columns if c not in keys])
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
