"""Early exposure against two-way responses, per user and per exposure bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.bins import cut_left_closed
from cohortlens.operators.firsts import first_per_key, top_rows
from cohortlens.operators.matching import merge_renamed
from cohortlens.operators.quantiles import box_outliers, box_stats
from cohortlens.sources.grids import bin_spine

# The bucket looked at, exposure bin edges, and the column names.
BUCKET = 2
EDGES = (0, 3100, 100)
RESPONSES = "cumul_rcmd_2way_response_users"
RESPONSES_RR = "cumul_rcmd_2way_response_users_rr"


def latest_responses(rr: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Each user's row with the latest bucket up to ``bucket``."""
    return first_per_key(
        rr.filter(F.col("min_rr") <= bucket),
        ["user2_id"],
        [F.desc_nulls_last("min_rr"), F.desc_nulls_last(RESPONSES)],
    )


def early_exposure_response(
    rc: DataFrame, rr: DataFrame, bucket: int = BUCKET, fill: bool = True
) -> DataFrame:
    """Exposure rows of ``bucket`` with the latest responses up to it (0 where none)."""
    merged = merge_renamed(
        rc.filter(F.col("min_rc") == bucket),
        latest_responses(rr, bucket),
        "user2_id",
        [RESPONSES],
        "_rr",
    )
    return merged.na.fill({RESPONSES_RR: 0}) if fill else merged


def top_responders(rc: DataFrame, rr: DataFrame, bucket: int = BUCKET, n: int = 10) -> DataFrame:
    """The ``n`` rows with most two-way responses, missing ones last."""
    merged = early_exposure_response(rc, rr, bucket, fill=False)
    return top_rows(
        merged,
        [
            F.desc_nulls_last(RESPONSES_RR),
            F.asc_nulls_last("user2_id"),
            F.desc_nulls_last("cumul_rcmd_users"),
        ],
        n,
    )


def _responders(rows: DataFrame, edges: tuple[int, int, int]) -> DataFrame:
    return (
        rows.filter(F.col(RESPONSES_RR) > 0)
        .withColumn("bin_idx", cut_left_closed(F.col("cumul_rcmd_users"), *edges))
        .filter(F.col("bin_idx").isNotNull())
    )


def response_boxes(rows: DataFrame, edges: tuple[int, int, int] = EDGES) -> DataFrame:
    """Median and box statistics of two-way responses per exposure bin; all bins are listed.

    ``rows`` is the filled output of ``early_exposure_response``.
    """
    stats = box_stats(_responders(rows, edges), ["bin_idx"], RESPONSES_RR, counted=True)
    return bin_spine(rows.sparkSession, *edges).join(stats, "bin_idx", "left")


def response_outliers(rows: DataFrame, edges: tuple[int, int, int] = EDGES) -> DataFrame:
    """The rows beyond the whiskers of their exposure bin."""
    return box_outliers(_responders(rows, edges), ["bin_idx"], RESPONSES_RR, counted=True)
