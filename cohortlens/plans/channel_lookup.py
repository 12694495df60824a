"""Which recommendation type, channel and place each channel id stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.matching import left_lookup
from cohortlens.sources.scans import date_partitions, snapshots

# First day left out, and where the channel name holds the place id.
AFTER = "2025-12-10"
PLACE_ID_AT = (17, 3)


def channel_lookup(
    daily: DataFrame,
    type_map: DataFrame,
    channels: DataFrame,
    places: DataFrame,
    after: str = AFTER,
    latest_only: bool = False,
) -> DataFrame:
    """Distinct (channel id, all type-map columns, channel name, place title).

    Every input is reduced to its distinct used columns before the joins, so the
    daily fact and the repeated snapshots never meet each other in full. A type with
    no mapping and a channel with no place stay with NULLs. Sorted by mapped type,
    then channel id.
    """
    used = date_partitions(daily, after=after).select("channel_id", "rcmd_type").distinct()
    names = (
        snapshots(channels, after, ["id", "name"], latest_only)
        .distinct()
        .select(F.col("id").alias("_channel"), F.col("name").alias("channel_name"))
    )
    titles = (
        snapshots(places, after, ["id", "title"], latest_only)
        .distinct()
        .select(F.col("id").cast("string").alias("_place"), F.col("title").alias("place_title"))
    )
    mapped = type_map.withColumn("_type", F.col("rcmd_type"))
    typed = left_lookup(
        used.withColumnRenamed("rcmd_type", "_used_type"), mapped, F.col("_type") == F.col("_used_type")
    )
    named = left_lookup(typed, names, F.col("_channel") == F.col("channel_id"))
    placed = left_lookup(
        named, titles, F.col("_place") == F.substring("channel_name", *PLACE_ID_AT)
    )
    return (
        placed.select("channel_id", *type_map.columns, "channel_name", "place_title")
        .distinct()
        .orderBy(F.asc_nulls_last("rcmd_type"), F.asc_nulls_last("channel_id"))
    )
