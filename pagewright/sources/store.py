"""A table of keyed rows that several writers change at once: data folders, and a log of numbered manifests.

A commit writes its rows to a folder of its own and then creates the next manifest, which names all folders up to it. A manifest is
created whole and only if its number is free, so one of two writers wins; the other one looks again and takes the next number. Nothing
is ever changed in place: readers see a version or the next, a writer that dies leaves folders that no manifest names, and a version stays
readable while others are written.

Of a key's rows the one of the latest commit counts; a row marked removed takes its key away. A guarded update is refused where a
commit after the version it was made from has changed one of its keys.

Defined results: an empty log has version 0 and no rows; of rows of one key in one commit any one counts, so commits should hold one; null
keys are equal to each other; columns may be added by later commits (earlier rows have nulls).
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times that a commit tries for a number.
TRIES = 100


class Conflict(Exception):
    """Keys were changed after the version that an update was made from, or no number was free."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # manifests

    def _manifest(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        return jvm, folder, folder.getFileSystem(conf)

    def version(self) -> int:
        """The number of the last commit."""
        _, folder, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def folders(self, version: int) -> list[tuple[int, str]]:
        """(commit, folder) of all that a version holds, the earliest first."""
        if version == 0:
            return []
        text = self.spark.read.text(self._manifest(version), wholetext=True).first()
        return [(c, f) for c, f in json.loads(text.value)["folders"]]

    def _create(self, version: int, folders: list[tuple[int, str]]) -> bool:
        """Create a manifest whole, only if its number is free."""
        text, target = json.dumps({"version": version, "folders": folders}), self._manifest(version)
        local = urlparse(target).scheme in ("", "file")
        return self._linked(text, unquote(urlparse(target).path)) if local else self._renamed(text, target)

    @staticmethod
    def _linked(text: str, place: str) -> bool:
        """On a local file system a hard link is made only where there is none."""
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(own := f"{place}.{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        try:
            os.link(own, place)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True

    def _renamed(self, text: str, target: str) -> bool:
        """In Hadoop's file systems a rename without overwriting is refused where the name is taken."""
        jvm, folder, fs = self._fs()
        own, place = jvm.org.apache.hadoop.fs.Path(folder, f"{uuid.uuid4().hex}.part"), jvm.org.apache.hadoop.fs.Path(target)
        out = fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)  # without overwriting
        try:
            context.rename(own, place, plain)
        except Py4JJavaError:
            taken = fs.exists(place)
            fs.delete(own, False)
            if not taken:
                raise
            return False
        return True

    # rows

    def _written(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def _rows(self, folders: list[tuple[int, str]]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/{f}").withColumn("_commit", F.lit(c).cast("long")) for c, f in folders]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the last by default; None where nothing was ever committed."""
        rows = self._rows(self.folders(self.version() if version is None else version))
        if rows is None:
            return None
        columns = [c for c in rows.columns if c not in (self.key, "_commit")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_commit").alias("_r"))
        return last.select(self.key, *[F.col(f"_r.{c}").alias(c) for c in columns]).filter(~F.coalesce("removed", F.lit(False))).drop("removed")

    def _commit(self, rows: DataFrame, read_at: int | None) -> int:
        folder = self._written(rows)
        seen = read_at
        for _ in range(TRIES):
            now = self.version()
            held = self.folders(now)
            if seen is not None and now > seen:  # what was committed meanwhile
                later = self._rows([(c, f) for c, f in held if c > seen])
                mine = self.spark.read.parquet(f"{self.path}/{folder}").select(self.key)
                if later is not None:
                    both = mine.join(later.select(F.col(self.key).alias("_k")).distinct(), F.col(self.key).eqNullSafe(F.col("_k"))).limit(3).collect()
                    if both:
                        raise Conflict(f"changed after version {read_at}: {', '.join(str(r[0]) for r in both)}")
                seen = now
            if self._create(now + 1, [*held, (now + 1, folder)]):
                return now + 1
        raise Conflict(f"no number was free in {TRIES} tries")

    def upsert(self, rows: DataFrame) -> int:
        """Commit rows over whatever their keys hold; the version."""
        return self._commit(rows.withColumn("removed", F.lit(False)), None)

    def update(self, rows: DataFrame, read_at: int) -> int:
        """Commit rows that were made from version ``read_at``; a Conflict where their keys have changed since."""
        return self._commit(rows.withColumn("removed", F.lit(False)), read_at)

    def remove(self, keys: DataFrame, read_at: int | None = None) -> int:
        return self._commit(keys.select(self.key).withColumn("removed", F.lit(True)), read_at)

    def compact(self) -> int:
        """Commit one folder in place of all; earlier versions keep theirs. Given up where another commit comes first."""
        now = self.version()
        rows = self.read(now)
        if rows is None or len(self.folders(now)) < 2:
            return now
        folder = self._written(rows.withColumn("removed", F.lit(False)))
        return now + 1 if self._create(now + 1, [(now + 1, folder)]) else self.version()
