"""Distinct users by score grade and exposure-count bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.bins import cut_right_closed, score_grade
from cohortlens.operators.firsts import first_per_key
from cohortlens.operators.pivots import distinct_users_by_bin

# Grade width and bin edges.
GRADE_WIDTH = 30
EDGES = (0, 1000, 100)
MODES = ("all", "max_per_user")


def exposure_histogram(
    df: DataFrame,
    grade_width: int = GRADE_WIDTH,
    edges: tuple[int, int, int] = EDGES,
    mode: str = "all",
    max_interval: float | None = None,
) -> DataFrame:
    """Grades down, right-closed bins (named by upper edge) across.

    ``mode`` "all" counts every row, "max_per_user" only the row with the user's
    largest count; ``max_interval`` first restricts to rows within that many hours.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if max_interval is not None:
        df = df.filter(F.col("del_interval_hour") <= max_interval)
    if mode == "max_per_user":
        df = first_per_key(
            df,
            ["user_id"],
            [
                F.desc_nulls_last("rcmd_cnt"),
                F.asc_nulls_last("relative_score"),
                F.asc_nulls_last("del_interval_hour"),
            ],
        )
    start, stop, width = edges
    binned = df.select(
        "user_id",
        score_grade(F.col("relative_score"), grade_width).alias("grade"),
        cut_right_closed(F.col("rcmd_cnt"), start, stop, width).alias("bin"),
    )
    labels = list(range(start + width, stop + width, width))
    return distinct_users_by_bin(binned, "grade", "bin", "user_id", labels)
