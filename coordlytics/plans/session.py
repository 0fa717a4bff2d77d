"""Session settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # instants are compared and truncated in UTC
    "spark.sql.session.timeZone": "UTC",
    # split a skewed join side at run time even if the aggregation behind it then needs a shuffle
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # scans of one order share a shuffle only if each asks for whole rows of it (plans/ordered.py)
    "spark.sql.optimizer.expression.nestedPruning.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
