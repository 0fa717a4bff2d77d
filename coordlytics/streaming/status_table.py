"""A table of the latest row per key that micro-batches are merged into (IO9).

Keys are dealt over a fixed number of buckets. A merge rewrites only the buckets that the batch touches, into a folder
of its own, and then publishes a new version: a small file that names the folder of every bucket and
the last batch of every writer. Publishing is one rename, so a reader sees all of a batch or nothing of it; a batch that was
published is not applied again. A merge reads one version, whatever the number of batches before it.
Folders are deleted two versions after they were replaced, which is how long a reader of a version may take.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 32
KEPT = 2  # versions whose files stay

_BUCKET = "__bucket"


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


class Files:
    """Small text files next to the data, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.folder = self._path(folder)
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts):
        return self.jvm.org.apache.hadoop.fs.Path(*parts)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.folder)] if self.fs.exists(self.folder) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(self.folder, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write under another name first; the rename makes the file appear as a whole."""
        hidden = self._path(self.folder, f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(hidden)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(hidden, self._path(self.folder, name)):
            raise RuntimeError(f"{name} was published by another writer")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


class StatusTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.files = Files(spark, f"{self.path}/versions")

    def versions(self) -> list[int]:
        return sorted(int(n[: -len(".json")]) for n in self.files.names() if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int) -> dict:
        return json.loads(self.files.read(f"{number:012d}.json"))

    def current(self) -> dict:
        known = self.versions()
        return self.version(known[-1]) if known else {"number": 0, "buckets": self.buckets, "folders": {}, "applied": {}, "schema": None}

    def read(self) -> DataFrame:
        """The latest row per key."""
        now = self.current()
        if now["schema"] is None:
            raise AnalysisException(message=f"no status was written under {self.path}")
        return self._rows(now, sorted(now["folders"].values()))

    def _rows(self, version: dict, folders: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(version["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, writer: str, batch_id: int) -> bool:
        """Make ``batch`` part of the table; False if ``writer`` has applied this batch before."""
        now = self.current()
        if now["applied"].get(writer, -1) >= batch_id:
            return False
        buckets = now["buckets"]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")
        fresh = latest_rows(batch, self.keys, self.order).withColumn(_BUCKET, bucket)
        fresh = fresh.persist()
        try:
            touched = [r[_BUCKET] for r in fresh.select(_BUCKET).distinct().collect()]  # at most one per bucket
            schema = now["schema"] or json.loads(batch.schema.json())
            known = self._rows(now | {"schema": schema}, [now["folders"][str(b)] for b in touched if str(b) in now["folders"]])
            merged = latest_rows(known.unionByName(fresh.drop(_BUCKET)), self.keys, self.order).select(*batch.columns)
            folder = f"{self.path}/data/{now['number'] + 1:012d}-{uuid.uuid4().hex}"
            if touched:
                merged.withColumn(_BUCKET, bucket).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        finally:
            fresh.unpersist()
        following = {
            "number": now["number"] + 1, "buckets": buckets, "schema": schema, "applied": now["applied"] | {writer: batch_id},
            "folders": now["folders"] | {str(b): f"{folder}/{_BUCKET}={b}" for b in touched}}
        self.files.publish(f"{following['number']:012d}.json", json.dumps(following))
        self._forget()
        return True

    def _forget(self) -> None:
        """Delete old versions, and the folders that only they name."""
        known = self.versions()
        kept = {f for n in known[-KEPT:] for f in self.version(n)["folders"].values()}
        for number in known[:-KEPT]:
            for folder in set(self.version(number)["folders"].values()) - kept:
                self.files.delete(folder)
            self.files.delete(f"{self.path}/versions/{number:012d}.json")
