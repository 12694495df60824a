"""Wide tables from long cells, with explicit column lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.bounded import held

#: Most tables stacked in one pivot.
HELD_FRAMES = 10_000


def mean_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean of each measure per group; NULL keys and groups without any mean are left out."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(*[F.avg(m).alias(m) for m in measures])
        .dropna(how="all", subset=list(measures))
    )


def distinct_users_by_bin(
    df: DataFrame, row: str, bin_column: str, user: str, labels: Sequence[int]
) -> DataFrame:
    """Distinct users per row value (down) and bin (across), 0 where there are none.

    All bins get a column, and a row value whose rows all fall outside the bins
    stays as a row of zeros. NULL row values are left out.
    """
    names = [f"bin_{v}" for v in labels]
    return (
        df.filter(F.col(row).isNotNull())
        .groupBy(row)
        .pivot(bin_column, list(labels))
        .agg(F.count_distinct(F.col(user)))
        .toDF(row, *names)
        .na.fill(0, names)
    )


def pair_label(*parts: Column) -> Column:
    """Column label of a two-level heading."""
    return F.concat_ws("|", *parts)


def usage_pivot(
    cells: DataFrame,
    keys: Sequence[str],
    frame: Sequence[str],
    label: str,
    value: str,
    labels: Sequence[str],
) -> DataFrame:
    """Long cells (``keys``, ``label``, ``value``) to one column per label.

    ``frame`` (a subset of ``keys``) marks what would be separate tables stacked on
    each other: within a frame an absent cell is 0, but a label that never occurs in
    the frame is NULL. What occurs is read off the wide rows, one row per frame; there
    are as many frames as there would be tables, so that side is broadcast, and more than
    ``HELD_FRAMES`` of them are an error. A cell whose label has no column is an error.
    """
    missing = F.raise_error(F.concat(F.lit("no column for the label "), F.col(label)))
    known = cells.dropna(subset=[label, *keys]).withColumn(
        label, F.when(F.col(label).isin(list(labels)), F.col(label)).otherwise(missing)
    )
    wide = (
        known.groupBy(*keys).pivot(label, list(labels)).agg(F.sum(value))
    )
    named = wide.toDF(*keys, *[f"_v{i}" for i in range(len(labels))])
    occurs = named.groupBy(*frame).agg(
        *[F.expr(f"max(_v{i} IS NOT NULL)").alias(f"_o{i}") for i in range(len(labels))]
    )
    return named.join(held(occurs, HELD_FRAMES, "choose a coarser frame"), list(frame)).select(
        *keys,
        *[F.expr(f"CASE WHEN _o{i} THEN coalesce(_v{i}, 0) END").alias(c) for i, c in enumerate(labels)],
    )
