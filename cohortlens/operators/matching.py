"""Join shapes: computed keys, existence flags, residual conditions, role swaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def existence_flag(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` (one row per key) with ``flag`` = 1 where ``key`` occurs in ``keys``, else 0.

    ``keys`` is reduced to its distinct values first, so rows never multiply.
    """
    known = keys.select(key).distinct().withColumn(flag, F.lit(1))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in ``keys``; a NULL key occurs nowhere and stays."""
    known = keys.select(key).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, key, "left")
    return joined.filter(F.col("_known").isNull()).drop("_known")


def left_with_residual(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], residual: Column
) -> DataFrame:
    """Left join on ``keys`` and ``residual``, where ``per_key`` has one row per key.

    The residual (any condition over both sides; unknown counts as false) blanks the
    right columns after an equality join, so the per-key aggregate is joined in the
    partitioning it already has.
    """
    added = [c for c in per_key.columns if c not in keys]
    joined = rows.join(per_key, list(keys), "left")
    return joined.withColumn("_met", residual).select(
        *rows.columns, *[F.when(F.col("_met"), F.col(c)).alias(c) for c in added]
    )


def left_lookup(df: DataFrame, dim: DataFrame, on: Column) -> DataFrame:
    """Left join on an expression; equalities of computed keys still hash."""
    return df.join(dim, on, "left")


def merge_renamed(
    left: DataFrame,
    right: DataFrame,
    key: str,
    columns: Sequence[str],
    suffix: str,
    how: str = "left",
) -> DataFrame:
    """Join a column subset of ``right``; only names that ``left`` has too get ``suffix``.

    A NULL key matches nothing (a data-frame merge would pair NULL keys).
    """
    picked = right.select(
        key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in columns]
    )
    return left.join(picked, key, how)


def both_roles(df: DataFrame, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """Each row once per side: (``user_id``, ``other_id``, ``role`` 1 or 2, ``columns``).

    One scan and one aggregation then serve what would be two passes over the log.
    """
    sides = F.array(
        F.struct(F.col(first).alias("user_id"), F.col(second).alias("other_id"), F.lit(1).alias("role")),
        F.struct(F.col(second).alias("user_id"), F.col(first).alias("other_id"), F.lit(2).alias("role")),
    )
    return df.select(F.inline(sides), *columns)
