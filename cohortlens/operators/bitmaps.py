"""Distinct counts as bitmaps that add up: over days, and over groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.running import gapless_numbers


def dense_ids(rows: DataFrame, value: str, known: DataFrame | None = None) -> DataFrame:
    """(``value``, ``id``): a number for each different value, without gaps from 1.

    With ``known``, an earlier result, values keep their numbers and new ones go on
    behind the last, so bitmaps of earlier days stay valid.
    """
    new = rows.select(value).filter(F.col(value).isNotNull()).distinct()
    if known is None:
        numbered = gapless_numbers(new, [], value, "id")
        return numbered.select(value, (F.col("id") + 1).alias("id"))
    numbered = gapless_numbers(new.join(known, value, "left_anti"), [], value, "id")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    behind = numbered.withColumn("_one", F.lit(1)).join(last.withColumn("_one", F.lit(1)), "_one")
    return known.unionByName(behind.select(value, (F.col("id") + F.col("_last") + 1).alias("id")))


def day_bitmaps(
    rows: DataFrame, keys: Sequence[str], value: str, flags: Mapping[str, str], ids: DataFrame
) -> DataFrame:
    """(``keys``, ``bucket``, a bitmap for each flag) of the values that meet the flag.

    ``keys`` include the day; ``flags`` maps names to SQL conditions. A bitmap covers
    32,768 ids, so a group has one row for as many of them as there are buckets with its
    values: meant for groups that hold a good share of the ids, such as days, channels
    or types. The bitmaps are combined before the shuffle.
    """
    numbered = rows.join(ids.select(value, F.col("id").alias("_id")), value)
    bit = F.bitmap_bit_position("_id")
    return numbered.groupBy(*keys, F.bitmap_bucket_number("_id").alias("bucket")).agg(
        *[F.bitmap_construct_agg(F.when(F.expr(p), bit)).alias(n) for n, p in flags.items()]
    )


def merged_bitmaps(bitmaps: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Bitmaps of ``keys``, a part of the keys of ``bitmaps``: what any of the merged rows holds."""
    return bitmaps.groupBy(*keys, "bucket").agg(*[F.bitmap_or_agg(n).alias(n) for n in flags])


def bitmap_counts(bitmaps: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Distinct values per flag and group of ``keys``, whatever finer keys ``bitmaps`` has."""
    merged = merged_bitmaps(bitmaps, keys, flags)
    return merged.groupBy(*keys).agg(*[F.sum(F.bitmap_count(n)).alias(n) for n in flags])
