"""Intermediate tables in the shared folder: lineage cuts that survive lost executors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from coordlytics.plans.durable import fresh_path

_open: list[Scratch] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet under the cluster's checkpoint folder and read again."""
    path = fresh_path(df.sparkSession, label)
    if _open:
        _open[-1].paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables stored for one step of a computation."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` stored so that it outlives the step; all it was computed from may go."""
        out = stored(df, label)
        path = self.paths.pop()
        at = _open.index(self)
        if at:
            _open[at - 1].paths.append(path)
        return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes at its end what was stored within, but for what was stored with ``keep``.

    Nothing lazy that reads these tables may leave the block.
    """
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
        for path in own.paths:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)
