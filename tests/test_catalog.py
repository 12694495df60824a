"""Every registered query against its SQL, and the shape of the physical plans."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from cohortlens.catalog import REGISTRY
from tests.oracle import compare, connect

NAMES = sorted(REGISTRY)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert contract.queries().keys() >= contract.oracle_sql().keys() >= REGISTRY.keys()


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, sf_dir, con, name):
    df = contract.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|MapInPandas", plan)
    assert compare(df, con, contract.oracle_sql()[name]) == []


JOINS = [
    "two_sided_funnel",
    "exposure_timeline",
    "ab_readout",
    "usage_before_after_purchase",
    "early_response_boxes",
    "theta_residual_join",
    "using_join",
    "anti_join",
    "merge_suffix",
]


@pytest.mark.parametrize("name", JOINS)
def test_same_rows_without_broadcasts(spark, sf_dir, con, no_broadcast, name):
    df = contract.queries()[name](spark, sf_dir)
    assert compare(df, con, contract.oracle_sql()[name]) == []


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_day_reads_the_days_of_the_cohort_only(spark, sf_dir):
    from pyspark.sql import functions as F

    from cohortlens.catalog import stored

    df = contract.queries()["cohort_first_day"](spark, sf_dir)
    plan = executed(df)
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan)
    log = stored.daily_log(spark, sf_dir)
    days = {r[0] for r in df.select(F.col("approval_date").cast("string")).distinct().collect()}
    assert 0 < len(days) < log.select("date_ymd_kst").distinct().count()
    assert stored.daily_log(spark, sf_dir).inputFiles() == log.inputFiles()


def test_bucketed_cohort_shuffles_less(spark, sf_dir, no_broadcast):
    """Without broadcasts every join of the plain job shuffles; the bucketed one only its coupon branch."""
    runs = contract.queries()
    plain = executed(runs["reward_cohort"](spark, sf_dir)).count("Exchange hashpartitioning")
    bucketed = executed(runs["reward_cohort_bucketed"](spark, sf_dir)).count("Exchange hashpartitioning")
    assert bucketed <= 5 < plain / 2, (bucketed, plain)


@pytest.mark.parametrize("name", ["latest_per_key", "max_per_key"])
def test_best_rows_without_sorting(spark, sf_dir, name):
    plan = executed(contract.queries()[name](spark, sf_dir))
    assert "Sort" not in plan and "Window" not in plan and plan.count("ObjectHashAggregate") == 2


def test_retention_state(spark, sf_dir, tmp_path):
    from cohortlens.catalog import composed, standins, stored
    from cohortlens.operators.retention_state import RetentionState, day_bits, retention_of_state
    from cohortlens.plans import reward_cohort as rw
    from tests.conftest import rows_of

    cohort = rw.with_approval_date(composed._cohort(spark, sf_dir)).cache()
    daily = stored.w.stored(
        spark, "daily_screens", [f"{sf_dir}/events.parquet"], lambda: standins.screen_log(spark, sf_dir), stored.w.by_day
    )
    state = RetentionState(spark, str(tmp_path / "state"), rw.BOX_SCREEN)
    assert state.read().collect() == []
    steps = [("2024-01-01", "2024-01-05"), ("2024-01-06", "2024-01-06"), ("2024-01-06", "2024-01-06"), ("2024-01-07", "2024-01-31")]
    for i, (since, until) in enumerate(steps):
        days = state.add_days(daily, since, until)
        full = rw.cohort_retention(cohort, standins.screen_log(spark, sf_dir), ("2024-01-01", until))
        if i != 1:
            assert rows_of(retention_of_state(days, cohort), *full.columns) == rows_of(full)
    assert state.days == steps and len(list((tmp_path / "state").glob("state-*"))) == 1
    plan = executed(day_bits(stored.date_partitions(daily, "2024-01-06", "2024-01-06"), rw.BOX_SCREEN))
    assert re.search(r"PartitionFilters: \[[^\]]*2024-01-06", plan)
    broken = daily.withColumn("navigations", composed.F.raise_error(composed.F.lit("no")).cast("array<string>"))
    with pytest.raises(Exception, match="no"):
        state.add_days(broken, "2024-01-08", "2024-01-08")
    assert state.days == steps and state.read().count() == days.count()
    cohort.unpersist()


def test_days_over_block_ends(spark):
    from pyspark.sql import functions as F

    from cohortlens.operators.retention import daily_screens, retention_flags
    from cohortlens.operators.retention_state import day_bits, retention_of_state
    from tests.conftest import rows_of

    days = spark.range(220).select((F.col("id") % 11).alias("user_id"), F.date_add(F.lit("2023-12-20").cast("date"), (F.col("id") * 7 % 90).cast("int")).alias("d"))
    log = days.select("user_id", F.array(F.when(F.day("d") == 3, "box").otherwise("x")).alias("navigations"), F.col("d").cast("string").alias("date_ymd_kst"))
    cohort = spark.range(12).select(
        F.col("id").alias("user_id"),
        F.when(F.col("id") < 10, F.date_add(F.lit("2023-12-25").cast("date"), (F.col("id") * 6).cast("int"))).alias("approval_date"),
    )
    want = retention_flags(daily_screens(log, "box"), cohort)
    assert rows_of(retention_of_state(day_bits(log, "box"), cohort), *want.columns) == rows_of(want)


def test_bitmaps_of_days_merge(spark):
    from pyspark.sql import functions as F

    from cohortlens.operators import bitmaps as b
    from tests.conftest import rows_of

    rows = spark.range(100_000).select(
        (F.col("id") % 3).alias("day"), (F.col("id") % 2).alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") * 977 % 70_001).alias("v"), "id"
    )
    early = b.dense_ids(rows.filter("day = 0"), "v")
    ids = b.dense_ids(rows, "v", early)
    assert ids.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first() == (*[rows.select("v").distinct().count() - 1] * 2, 1, rows.select("v").distinct().count() - 1)
    assert ids.join(early, ["v", "id"]).count() == early.count()
    flags = {"every": "true", "some": "id % 7 = 0", "none": "false"}
    parts = [b.day_bitmaps(rows.filter(F.col("day") == d), ["day", "k"], "v", flags, ids) for d in range(3)]
    daily = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for keys in (["k"], ["day"], []):
        want = rows.groupBy(*keys).agg(*[F.count_distinct(F.when(F.expr(p), F.col("v"))).alias(n) for n, p in flags.items()])
        assert rows_of(b.bitmap_counts(daily, keys, list(flags))) == rows_of(want)
