"""Running sums: over pre-aggregated buckets, and over raw rows of hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: Sequence[str],
    prefix: str = "cumul_",
) -> DataFrame:
    """Running sum of each measure from the first row of the key to the current one.

    All sums share one window. Meant for tables already aggregated to time buckets,
    where a key has no more rows than there are buckets; for raw rows use
    ``running_totals``.
    """
    spec = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumns({prefix + m: F.sum(m).over(spec) for m in measures})


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slice_of: Column,
    totals: Mapping[str, Column],
) -> DataFrame:
    """Running sums over raw rows, for keys of any size.

    ``slice_of`` must not decrease along ``order`` (the hour of an order by time,
    for example). Each (key, slice) piece is scanned on its own; what came before
    it is added from the per-slice totals, of which a key has no more than there
    are slices. Rows with a NULL key or slice belong to no sequence: they are kept
    with NULL totals.
    """
    cut = rows.withColumns({"_slice": slice_of} | {f"_m_{n}": c for n, c in totals.items()})
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cut.groupBy(*keys, "_slice")
        .agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in totals])
        .select(
            *keys,
            "_slice",
            *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
        )
    )
    summed = cut.withColumns(
        {n: F.coalesce(F.sum(f"_m_{n}").over(inside), F.lit(0)) for n in totals}
    )
    return (
        summed.join(offsets, [*keys, "_slice"], "left")
        .withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in totals})
        .drop("_slice", *[f"_m_{n}" for n in totals], *[f"_o_{n}" for n in totals])
    )


def gapless_numbers(df: DataFrame, keys: Sequence[str], by: str, name: str, pieces: int = 256) -> DataFrame:
    """``df`` with numbers from 0 without gaps within each key, in no set order between pieces.

    Rows with a NULL in ``keys`` are left out; without ``keys`` all rows are one key. A key is cut into ``pieces`` by the hash of the column ``by``; each is numbered on its own
    and begins after those before it, so no key is numbered in one task.
    """
    piece = F.pmod(F.xxhash64(by), F.lit(pieces)).cast("int")
    cut = df.withColumn("_piece", piece)
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, "_piece")
        .agg(F.count("*").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    own = Window.partitionBy(*keys, "_piece").orderBy(by)
    return (
        cut.withColumn("_own", F.row_number().over(own) - 1)
        .join(starts, [*keys, "_piece"])
        .withColumn(name, F.col("_own") + F.col("_start"))
        .drop("_piece", "_own", "_start")
    )
