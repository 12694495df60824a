"""One row per key, chosen by an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under ``order``.

    The planner turns the rank test into a group limit that keeps one row per key
    and task before the shuffle, so the number of rows of a key does not matter.
    End ``order`` with a unique column where ties are possible.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(spec)).filter("_rn = 1").drop("_rn")


def best_per_key(
    df: DataFrame, keys: Sequence[str], by: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """``columns`` of the row of each key whose ``by`` is greatest, compared from left to right.

    NULL is less than anything; negate a number to prefer small ones. End ``by`` with a
    unique column where ties are possible. One aggregate, combined before the shuffle,
    without ranking: a key costs one kept row in a task, and no task sorts its rows. The
    empty collection makes the planner keep the rows in a hash table; without it, rows
    that hold text would be sorted. NULL keys are a key.
    """
    row = F.struct(*[F.col(c) for c in columns])
    best = F.max_by(row, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)]))
    hashed = F.collect_set(F.lit(None).cast("int"))
    return (
        df.groupBy(*keys)
        .agg(best.alias("_best"), hashed.alias("_hashed"))
        .filter(F.size("_hashed") == 0)
        .select(*keys, *[F.col("_best")[c].alias(c) for c in columns])
    )


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of the whole table under ``order`` (per-task top-n, then merged)."""
    return df.orderBy(*order).limit(n)
