"""What every registered query does first."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows sent to a Python worker at once; texts are long, so far fewer than Spark's default.
BATCH_ROWS = 2000


def tuned(spark: SparkSession) -> SparkSession:
    """Session settings the queries rely on: UTC, adaptive plans, small Arrow batches."""
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    }.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark
