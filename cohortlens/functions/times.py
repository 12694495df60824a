"""Time arithmetic on zone-free UTC instants and their KST (UTC+9) dates.

Elapsed units are complete units, truncated toward zero. They are taken from the
exact day-time interval, so the result does not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KST_OFFSET = "INTERVAL '9' HOUR"


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def to_kst(ts: Column) -> Column:
    return ts + F.expr(KST_OFFSET)


def kst_instant(text: str) -> Column:
    """The UTC instant at which a KST clock shows ``text``."""
    return instant(text) - F.expr(KST_OFFSET)


def kst_date(ts: Column) -> Column:
    return F.to_date(to_kst(ts))


def full_hours(start: str, end: str) -> Column:
    """Complete hours from ``start`` to ``end`` (bigint, negative when reversed).

    Both are column names or SQL expressions of zone-free instants.
    """
    gap = f"({end} - {start})"
    return F.expr(f"extract(DAY FROM {gap}) * 24L + extract(HOUR FROM {gap})")


def full_minutes(start: str, end: str) -> Column:
    """Complete minutes from ``start`` to ``end`` (bigint, negative when reversed)."""
    gap = f"({end} - {start})"
    return F.expr(
        f"extract(DAY FROM {gap}) * 1440L + extract(HOUR FROM {gap}) * 60L"
        f" + extract(MINUTE FROM {gap})"
    )


def day_gap(start: Column, end: Column) -> Column:
    """Calendar days from date ``start`` to date ``end``."""
    return F.datediff(end, start)


def time_bucket(elapsed: Column, width: int) -> Column:
    """Whole buckets in ``elapsed``, truncated toward zero (so -4..4 share bucket 0 of width 5)."""
    return F.call_function("div", elapsed, F.lit(width).cast("bigint"))


def in_kst_days(ts: Column, first_day: str, last_day: str) -> Column:
    """``date(ts + 9h) between first_day and last_day``, as a range on the raw column.

    The shift sits on the constants, so the test reaches the Parquet scan.
    """
    return (ts >= kst_instant(f"{first_day} 00:00:00")) & (
        ts < kst_instant(f"{last_day} 00:00:00") + F.expr("INTERVAL '1' DAY")
    )


def in_days(ts: Column, first_day: str, last_day: str) -> Column:
    """``date(ts) between first_day and last_day`` as a range on the raw column, no shift."""
    return (ts >= instant(f"{first_day} 00:00:00")) & (
        ts < instant(f"{last_day} 00:00:00") + F.expr("INTERVAL '1' DAY")
    )
