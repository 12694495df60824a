"""Scans restricted by string partition columns and by hour boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.bounded import held

#: Days that a runtime filter may hold.
HELD_DAYS = 50_000


def date_partitions(
    df: DataFrame,
    since: str | None = None,
    until: str | None = None,
    after: str | None = None,
    days: Sequence[str] | None = None,
    column: str = "date_ymd_kst",
) -> DataFrame:
    """Rows of the wanted day partitions; plain string tests, so partitions are pruned."""
    if since is not None:
        df = df.filter(F.col(column) >= since)
    if until is not None:
        df = df.filter(F.col(column) <= until)
    if after is not None:
        df = df.filter(F.col(column) > after)
    if days is not None:
        df = df.filter(F.col(column).isin(list(days)))
    return df


def in_hours(
    start: tuple[str, int],
    end: tuple[str, int],
    date_column: str = "date_ymd_kst",
    hour_column: str = "hour_kst",
) -> Column:
    """From ``start`` (day, hour) to ``end`` (day, hour), both hours included.

    The leading ``between`` repeats what the branches imply, in a form that
    prunes partitions. An hour that is not a number fails on the two edge days only.
    """
    day, hour = F.col(date_column), F.col(hour_column).try_cast("int")
    (first_day, first_hour), (last_day, last_hour) = start, end
    if first_day == last_day:
        return (day == first_day) & hour.between(first_hour, last_hour)
    return day.between(first_day, last_day) & (
        ((day == first_day) & (hour >= first_hour))
        | ((day > first_day) & (day < last_day))
        | ((day == last_day) & (hour <= last_hour))
    )


def snapshots(
    df: DataFrame,
    after: str,
    columns: Sequence[str],
    latest_only: bool = False,
    column: str = "date_ymd_snapshot",
) -> DataFrame:
    """Rows of snapshots later than ``after``; several snapshots repeat each row.

    ``latest_only`` keeps the newest of them (a one-row aggregate, so the
    broadcast holds a single value).
    """
    kept = df.filter(F.col(column) > after)
    if latest_only:
        newest = kept.agg(F.max(column).alias(column))
        kept = kept.join(F.broadcast(newest), column, "left_semi")
    return kept.select(*columns)


def on_days_of(
    log: DataFrame, rows: DataFrame, day: Column | str, column: str = "date_ymd_kst"
) -> DataFrame:
    """Rows of ``log`` on the days that occur in ``rows``, a condition known at run time only.

    The different days are broadcast, and where ``column`` is a partition column the scan
    of ``log`` waits for them and opens their directories alone (dynamic partition
    pruning, which needs a filter among what ``rows`` comes from). ``day`` gives the day
    in the form of ``column``; NULL is no day.
    """
    days = rows.select((F.col(day) if isinstance(day, str) else day).alias(column)).distinct()
    return log.join(held(days, HELD_DAYS), column, "left_semi")
