"""Mean cumulative curves by score grade and minutes since joining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.bins import grade_label, score_grade
from cohortlens.operators.pivots import mean_by

# Grade width, minutes per bucket, grades shown, and the measures of
# the three extracts.
GRADE_WIDTH = 30
WIDTH_MIN = 5
GRADES = range(1, 11)
RECOMMENDATION_MEASURES = [
    "cumul_rcmd_users",
    "cumul_rcmd_response_users",
    "cumul_rcmd_users_ini_exc",
    "cumul_rcmd_response_users_ini_exc",
]
IMPRESSION_MEASURES = ["cumul_rcmd_impression_users", "cumul_rcmd_impression_users_rcmded"]
RESPONSE_MEASURES = ["cumul_rcmd_response_users", "cumul_rcmd_response_users_rcmded"]


def exposure_curves(
    df: DataFrame,
    score: str,
    measures: Sequence[str],
    grade_width: int = GRADE_WIDTH,
    width_min: int = WIDTH_MIN,
    grades: Sequence[int] = GRADES,
) -> DataFrame:
    """One row per (grade, time): the grade as text, its display label, and the means."""
    graded = df.select(
        score_grade(F.col(score), grade_width).alias("grade"),
        (F.col("min_rc") * width_min).alias("time"),
        *measures,
    )
    means = mean_by(graded, ["grade", "time"], measures).filter(F.col("grade").isin(*grades))
    return means.select(
        F.col("grade").cast("int").cast("string").alias("grade"),
        grade_label(F.col("grade")).alias("grade_label"),
        "time",
        *measures,
    )
