"""Grades, bins and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display label of each 30-wide score grade.
GRADE_LABELS = {1: "0-30%", 2: "30-60%", 3: "60-90%", 4: "90%-100%"}


def score_grade(score: Column, width: int) -> Column:
    """1-based grade of ``width`` points; negative scores floor below 1, NULL stays NULL."""
    return F.floor(score / width) + 1


def grade_label(grade: Column) -> Column:
    """Display label by grade; NULL for a grade without one."""
    label = F.lit(None).cast("string")
    for value, text in GRADE_LABELS.items():
        label = F.when(grade == value, text).otherwise(label)
    return label


def cut_left_closed(value: Column, start: int, stop: int, width: int) -> Column:
    """Ordinal of the bin ``[a, a+width)`` that holds ``value``; NULL outside ``[start, stop)``."""
    return F.when(
        (value >= start) & (value < stop), F.floor((value - start) / width)
    ).cast("int")


def cut_right_closed(value: Column, start: int, stop: int, width: int) -> Column:
    """Upper edge of the bin ``(a, a+width]`` that holds ``value``.

    The first bin also holds ``start`` itself; NULL outside ``[start, stop]``.
    """
    return F.when(
        value.between(start, stop),
        F.greatest(F.ceil((value - start) / width), F.lit(1)) * width + start,
    ).cast("int")
