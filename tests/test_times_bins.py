"""Time arithmetic, bins and ratios on hand-written frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import bins, measures
from cohortlens.functions import times as t
from cohortlens.sources.grids import bin_spine, with_grid
from tests.conftest import rows_of

TIME_PAIRS = [
    (1, "2025-12-01 00:10:00", "2025-12-01 00:06:00"),  # -4 minutes
    (2, "2025-12-01 00:10:00", "2025-12-01 00:09:00"),  # -1 minute
    (3, "2025-12-01 00:30:00", "2025-12-01 01:29:59"),  # 59 min 59 s
    (4, "2025-12-01 00:00:00", "2025-12-09 00:00:00"),  # 192 h
    (5, "2025-12-01 00:00:00", "2025-12-16 00:00:00"),  # 360 h
    (6, "2025-12-01 00:00:00", None),
    (7, "2025-12-01 02:00:00", "2025-12-01 00:00:01"),  # almost -2 h
]


def test_complete_units_truncate_toward_zero(frame):
    df = frame("id int, a timestamp_ntz, b timestamp_ntz", TIME_PAIRS)
    minutes = t.full_minutes("a", "b")
    got = df.select("id", t.full_hours("a", "b"), minutes, t.time_bucket(minutes, 5))
    assert rows_of(got) == [
        (1, 0, -4, 0),
        (2, 0, -1, 0),
        (3, 0, 59, 11),
        (4, 192, 11520, 2304),
        (5, 360, 21600, 4320),
        (6, None, None, None),
        (7, -1, -119, -23),
    ]


def test_elapsed_units_ignore_the_session_zone(spark, frame):
    df = frame("a timestamp_ntz, b timestamp_ntz", [("2025-03-30 00:00:00", "2025-03-30 12:00:00")])
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(t.full_hours("a", "b")).first()[0] == 12
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_kst_days_cover_the_last_day_and_equal_the_date_form(frame):
    df = frame(
        "id int, ts timestamp_ntz",
        [
            (1, "2025-11-30 14:59:59"),
            (2, "2025-11-30 15:00:00"),
            (3, "2025-12-28 14:59:59"),
            (4, "2025-12-28 15:00:00"),
            (5, None),
        ],
    )
    ranged = df.filter(t.in_kst_days(F.col("ts"), "2025-12-01", "2025-12-28"))
    dated = df.filter(t.kst_date(F.col("ts")).between("2025-12-01", "2025-12-28"))
    assert rows_of(ranged, "id") == rows_of(dated, "id") == [(2,), (3,)]


def test_kst_range_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = events.filter(t.in_kst_days(F.col("ts"), "2024-01-05", "2024-01-06")).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


CUT = [-1, 0, 99, 100, 101, 1000, 1001, 3099, 3100, None]


def test_left_closed_bins(frame):
    df = frame("v bigint", [(v,) for v in CUT])
    got = {r[0]: r[1] for r in df.select("v", bins.cut_left_closed(F.col("v"), 0, 3100, 100)).collect()}
    assert got == {
        -1: None, 0: 0, 99: 0, 100: 1, 101: 1, 1000: 10, 1001: 10, 3099: 30, 3100: None, None: None,
    }


def test_right_closed_bins_with_lowest(frame):
    df = frame("v bigint", [(v,) for v in CUT])
    got = {r[0]: r[1] for r in df.select("v", bins.cut_right_closed(F.col("v"), 0, 1000, 100)).collect()}
    assert got == {
        -1: None, 0: 100, 99: 100, 100: 100, 101: 200, 1000: 1000, 1001: None, 3099: None,
        3100: None, None: None,
    }


def test_grades_floor_and_keep_null(frame):
    df = frame("s double", [(-0.5,), (0.0,), (29.99,), (30.0,), (95.0,), (None,)])
    grade = bins.score_grade(F.col("s"), 30)
    got = {r[0]: (r[1], r[2]) for r in df.select("s", grade, bins.grade_label(grade)).collect()}
    assert got == {
        -0.5: (0, None),
        0.0: (1, "0-30%"),
        29.99: (1, "0-30%"),
        30.0: (2, "30-60%"),
        95.0: (4, "90%-100%"),
        None: (None, None),
    }


def test_percent_rounds_half_up_to_one_decimal(frame):
    df = frame("a bigint, b bigint", [(1, 3), (2, 3), (1, 2000), (3, 2000), (5, 0), (667, 2000)])
    got = rows_of(df.select("a", "b", measures.percent(F.col("a"), F.col("b")).cast("string")))
    assert got == [
        (1, 2000, "0.1"), (1, 3, "33.3"), (2, 3, "66.7"), (3, 2000, "0.2"), (5, 0, None),
        (667, 2000, "33.4"),
    ]


def test_grid_rows_and_empty_grid(frame):
    df = frame("id int, n int", [(1, 2), (2, -1), (3, None)])
    assert rows_of(with_grid(df, F.col("n"), "i"), "id", "i") == [(1, 0), (1, 1), (1, 2)]


@pytest.mark.parametrize(("edges", "count"), [((0, 3100, 100), 31), ((0, 1000, 100), 10)])
def test_bin_spine_length(spark, edges, count):
    spine = bin_spine(spark, *edges)
    assert spine.count() == count
    assert rows_of(spine)[0] == (0, 0, 100)
