"""Integer grids and bin edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_grid(df: DataFrame, stop: int | Column, name: str, start: int | Column = 0) -> DataFrame:
    """Every row of ``df`` once per integer in ``start..stop``, both included.

    A per-row ``explode`` instead of a cross join: no second relation, no shuffle.
    Rows with ``stop < start`` yield nothing.
    """
    lo = F.lit(start) if isinstance(start, int) else start
    hi = F.lit(stop) if isinstance(stop, int) else stop
    steps = F.when(hi >= lo, F.sequence(lo.cast("int"), hi.cast("int")))
    return df.withColumn(name, F.explode(steps))


def bin_spine(spark: SparkSession, start: int, stop: int, width: int) -> DataFrame:
    """One row per bin ``[bin_lo, bin_hi)`` with its ordinal ``bin_idx``."""
    bins = (stop - start) // width
    return spark.range(bins).select(
        F.col("id").cast("int").alias("bin_idx"),
        (F.col("id") * width + start).alias("bin_lo"),
        (F.col("id") * width + start + width).alias("bin_hi"),
    )
