"""Session settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A key with a third of all rows is split also where an aggregate behind the join
    # would reuse its partitioning, at the price of one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Keys that an aggregate of whole rows holds in a task before it goes over to sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "cohortlens", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` entries (dots as ``__``) win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | {k.replace("__", "."): str(v) for k, v in extra.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
