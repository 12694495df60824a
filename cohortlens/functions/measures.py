"""Aggregate expressions over conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_when(condition: Column, counted: Column | None = None) -> Column:
    """Rows where ``condition`` holds and ``counted`` (if given) is not NULL."""
    return F.count(F.when(condition, F.lit(1) if counted is None else counted))


def any_flag(condition: Column) -> Column:
    """1 if any row of the group meets ``condition``, else 0."""
    return F.max(F.when(condition, 1).otherwise(0))


def percent(part: Column, whole: Column) -> Column:
    """``part * 100 / whole`` rounded half up to one decimal; NULL for an empty whole."""
    exact = F.try_divide(
        part.cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)"), whole.cast("decimal(20,0)")
    )
    return exact.cast("decimal(23,1)")
