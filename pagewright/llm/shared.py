"""What the operators share: scratch tables in the cluster's shared folder, and word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that go to a Python worker at once, where ``small_batches`` has set it.
BATCH_BYTES = 4_000_000
#: The lists that tables written by keep() are noted in, the innermost last.
_noted: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that all executors and the driver share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir is not set; it names the folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read that.

    A lost executor costs one task of the write or of a read, never the steps before it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    for paths in _noted[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables() -> Iterator[list[str]]:
    """Notes the paths of tables that keep() writes meanwhile, for drop(); an outer list gets them too in the end."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        own = _noted.pop()
        for paths in _noted[-1:]:
            paths += own


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that no DataFrame still to be run reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it where ``df`` has a column of that name (in any case)."""
    held = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in held:
            n = "_" + n
        held.add(n.lower())
        out.append(n)
    return out


def slices(batch: pa.RecordBatch, column: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows with at most ``at_once`` bytes in a column (or one larger row), so that what is made of a run stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, begin = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + at_once, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def small_batches(spark: SparkSession) -> None:
    """From now on an Arrow batch of this session holds at most ``BATCH_BYTES`` (or one larger row); a smaller limit stays.

    Spark's own limits are 10,000 rows and 64 MB. An executor holds such a batch several times for each task, as what it sends to Python and
    as what it gets back, in buffers that are powers of two outside of its heap, and Python once more with what is made of it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _has_places(df: DataFrame) -> bool:
    """Whether ``df`` is a table as it was read, of a format that tells a row's file and place (Parquet does, JSON and ORC do not)."""
    plan = getattr(df, "_jdf", None)  # a remote session shows no plan
    if plan is None or plan.queryExecution().analyzed().nodeName() != "LogicalRelation" or "_metadata" in {c.lower() for c in df.columns}:
        return False
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` (source, place) that names each row for good.

    A table as it was read is not written again where its format tells each row's file and place. Any other DataFrame is written to the
    shared folder with numbers, as numbers made anew could come out otherwise.
    """
    if _has_places(df):
        return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("source"), F.col("_metadata.row_index").alias("place")))
    return keep(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("source"), F.monotonically_increasing_id().alias("place"))), "numbered")
