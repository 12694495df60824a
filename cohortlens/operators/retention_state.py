"""Retention over a kept state: each user's active days as bits, grown day by day.

The state has one row for each user and block of 64 days. It knows nothing of
cohorts, so any cohort can be read off it, also one of users who signed up later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.measures import any_flag
from cohortlens.operators.retention import ONLINE_DAYS, RETENTION_DAYS
from cohortlens.sources.extract_sets import MANIFEST, Folder
from cohortlens.sources.scans import date_partitions

BLOCK_DAYS = 64
SCHEMA = "user_id bigint, block bigint, active bigint, seen bigint"


def day_bits(screen_log: DataFrame, screen: str) -> DataFrame:
    """The state of the days in ``screen_log`` alone."""
    day = F.unix_date(F.to_date("date_ymd_kst")).cast("bigint")
    bit = F.expr("shiftleft(1L, CAST(pmod(_day, 64) AS INT))")
    there = F.array_contains("navigations", screen)
    return (
        screen_log.select("user_id", day.alias("_day"), there.alias("_seen"))
        .filter("_day IS NOT NULL")
        .groupBy("user_id", F.floor(F.col("_day") / BLOCK_DAYS).alias("block"))
        .agg(F.bit_or(bit).alias("active"), F.bit_or(F.when(F.col("_seen"), bit).otherwise(0)).alias("seen"))
    )


def merged_days(*states: DataFrame) -> DataFrame:
    """One state of several; merging a day again changes nothing."""
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("user_id", "block").agg(F.bit_or("active").alias("active"), F.bit_or("seen").alias("seen"))


def _bits(first: Column, last: Column) -> Column:
    """The bits of the days ``first`` to ``last`` (epoch days) in the block of the row."""
    start = F.col("block") * BLOCK_DAYS
    lo, hi = F.greatest(first - start, F.lit(0)), F.least(last - start, F.lit(BLOCK_DAYS - 1))
    width = (hi - lo + 1).cast("int")
    ones = F.when(width >= BLOCK_DAYS, F.lit(-1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), width) - 1)
    return F.when(first.isNotNull() & (width > 0), F.call_function("shiftleft", ones.cast("bigint"), lo.cast("int"))).otherwise(0).cast("bigint")


def retention_of_state(
    state: DataFrame, cohort: DataFrame, windows: Mapping[str, tuple[int, int]] = RETENTION_DAYS
) -> DataFrame:
    """The rows of ``retention_flags`` from a state: per cohort user with any active day.

    ``cohort`` has ``user_id`` and ``approval_date``, one row per user.
    """
    joined = state.join(cohort.select("user_id", "approval_date"), "user_id")
    start = F.unix_date("approval_date").cast("bigint")

    def within(lo: int, hi: int) -> Column:
        return F.col("active").bitwiseAND(_bits(start + lo, start + hi))

    return joined.groupBy("user_id").agg(
        *[any_flag(within(lo, hi) != 0).cast("bigint").alias(n) for n, (lo, hi) in windows.items()],
        F.sum(F.when(F.col("approval_date").isNotNull(), F.bit_count(within(*ONLINE_DAYS))).otherwise(0)).alias("online_date"),
        any_flag(F.col("seen") != 0).alias("check_coupon_box"),
    )


class RetentionState:
    """A state under ``path``, replaced as a whole with each batch of days."""

    def __init__(self, spark: SparkSession, path: str, screen: str) -> None:
        self.spark, self.path, self.screen = spark, path, screen

    def _manifest(self) -> dict:
        return json.loads(Folder(self.spark, self.path).read(MANIFEST) or '{"state": null, "days": []}')

    @property
    def days(self) -> list[tuple[str, str]]:
        """The batches merged so far, first and last day of each."""
        return [tuple(d) for d in self._manifest()["days"]]

    def read(self) -> DataFrame:
        kept = self._manifest()["state"]
        if kept is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{kept}")

    def add_days(self, screen_log: DataFrame, since: str, until: str) -> DataFrame:
        """Merge the days ``since`` to ``until`` of the log; returns the new state.

        Only the partitions of these days are read from ``screen_log``. The new state is
        written next to the old one and then named in the manifest, so a failed or
        repeated call leaves a state that is right.
        """
        folder, before = Folder(self.spark, self.path), self._manifest()
        new = day_bits(date_partitions(screen_log, since, until), self.screen)
        name = f"state-{uuid.uuid4().hex}"
        merged = merged_days(self.read(), new)
        try:
            merged.write.parquet(f"{self.path}/{name}")
        except BaseException:
            folder.remove(name)
            raise
        folder.replace(MANIFEST, json.dumps({"state": name, "days": [*before["days"], [since, until]]}))
        if before["state"]:
            folder.remove(before["state"])
        return self.read()
