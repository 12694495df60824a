"""Building blocks: joins, distinct flags, running totals, quantiles, pivots."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators import matching as m
from cohortlens.operators import quantiles as q
from cohortlens.operators.distincts import MAX_FLAGS, distinct_by_flags, flag_mask
from cohortlens.operators.firsts import first_per_key, top_rows
from cohortlens.operators.pivots import distinct_users_by_bin, mean_by, usage_pivot
from cohortlens.operators.running import running_totals
from cohortlens.operators.summary import describe_all
from cohortlens.sources.extracts import read_extract, write_extract
from cohortlens.sources.scans import date_partitions, in_hours, snapshots
from tests.conftest import rows_of


def test_a_hot_key_is_split_at_run_time(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    rows = spark.range(200_000).repartition(8).select(
        F.col("id").alias("row_id"), F.expr("if(id % 5 < 3, 1, id % 40)").alias("k")
    )
    dim = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x"))
    joined = m.merge_renamed(rows, dim, "k", ["x"], "_r").groupBy("k").agg(F.sum("x"))
    joined.collect()
    for key in settings:
        spark.conf.unset(key)
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_distinct_flags_keep_groups_with_only_null(frame):
    df = frame(
        "g string, v bigint, ok int",
        [("a", 1, 1), ("a", 1, 0), ("a", 2, 0), ("b", None, 1), ("c", 3, None), (None, 4, 1)],
    )
    got = distinct_by_flags(df, ["g"], "v", {"n": "true", "n_ok": "ok = 1"})
    want = df.groupBy("g").agg(
        F.count_distinct("v").alias("n"), F.count_distinct(F.expr("CASE WHEN ok = 1 THEN v END"))
    )
    assert rows_of(got) == rows_of(want)
    assert ("b", 0, 0) in rows_of(got)


def test_distinct_flags_do_not_multiply_rows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = distinct_by_flags(
        events, ["event_type"], "user_id", {f"f{i}": f"value > {i}" for i in range(8)}
    )
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()


def test_too_many_flags():
    with pytest.raises(ValueError):
        flag_mask({f"f{i}": "true" for i in range(MAX_FLAGS + 1)})


def test_first_per_key_orders_null_last_and_limits_before_the_shuffle(frame):
    df = frame("k int, o int, p string", [(1, None, "x"), (1, 2, "y"), (1, 2, "a"), (None, 1, "n"), (2, None, "z")])
    got = first_per_key(df, ["k"], [F.asc_nulls_last("o"), F.asc("p")])
    assert rows_of(got) == [(1, 2, "a"), (2, None, "z"), (None, 1, "n")]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_top_rows_is_a_top_n_not_a_full_sort(frame):
    df = frame("a int, b int", [(1, None), (2, 5), (3, 7), (4, 7)])
    got = top_rows(df, [F.desc_nulls_last("b"), F.asc("a")], 3)
    assert [tuple(r) for r in got.collect()] == [(3, 7), (4, 7), (2, 5)]
    assert "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()


def test_running_totals_equal_one_window(spark):
    rows = spark.range(2000).select(
        F.col("id"),
        F.expr("CASE WHEN id % 3 = 0 THEN 1 ELSE id % 20 END").alias("k"),
        F.expr("(id * 7919) % 500").alias("t"),
    )
    got = running_totals(
        rows, ["k"], [F.asc("t"), F.asc("id")], F.expr("t div 50"), {"n": F.lit(1), "s": F.col("id")}
    )
    spec = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("id", F.count("*").over(spec), F.sum("id").over(spec))
    assert rows_of(got, "id", "n", "s") == rows_of(want)


def test_running_totals_keep_rows_without_a_key(frame):
    rows = frame("k int, t int", [(1, 1), (1, 5), (None, 2)])
    got = running_totals(rows, ["k"], [F.asc("t")], F.col("t"), {"n": F.lit(1)})
    assert rows_of(got) == [(1, 1, 1), (1, 5, 2), (None, 2, None)]


@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [0.0, 0.0, 1e12, 3.0, -7.5, 2.0],
        list(np.random.default_rng(1).exponential(50, 501)),
        list(np.random.default_rng(2).integers(-20, 20, 400).astype(float)),
        [1.7e9 + i / 8 for i in range(100)],
    ],
)
def test_quantiles_equal_numpy(spark, values):
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(1, None), (2, 4.0)], "g int, v double")
    want = np.quantile(values, probs)
    for counted in (False, True):
        got = {r["g"]: r for r in q.exact_quantiles(df, ["g"], "v", probs, counted=counted).collect()}
        assert got[1]["n"] == len(values) and got[2]["q_2"] == 4.0
        assert [got[1][f"q_{i}"] for i in range(5)] == pytest.approx(list(want), rel=1e-12)


def test_value_slices_never_decrease(spark):
    xs = sorted(
        [0.0, 5e-324, -5e-324, 1e-9, 1.0, 1.5, 2.0, 3.0, 4095.0, 4096.0, 1e18, -1.0, -4096.5]
        + [2.0**k * f for k in range(-40, 60, 7) for f in (1 - 2**-53, 1.0, 1 + 2**-52)]
    )
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[1] for r in df.select("x", q.magnitude_slice(F.col("x"))).orderBy("x").collect()]
    assert got == sorted(got)


def test_box_statistics_and_outliers(spark):
    values = [10, 11, 12, 12, 13, 14, 15, 100, -50]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3)], "g string, v bigint")
    a = next(r for r in q.box_stats(df, ["g"], "v").collect() if r["g"] == "a")
    assert (a["n"], a["q1"], a["median"], a["q3"]) == (9, 11.0, 12.0, 14.0)
    assert (a["whisker_lo"], a["whisker_hi"], a["n_outliers"]) == (10.0, 15.0, 2)
    assert rows_of(q.box_outliers(df, ["g"], "v"), "v") == [(-50,), (100,)]


def test_describe_all_marks_what_does_not_apply(frame):
    df = frame("t string, x double", [("b", 1.0), ("a", 2.0), ("a", None), ("b", 4.0), (None, None)])
    got = {r["column_name"]: r for r in describe_all(df, ["x"], ["t"]).collect()}
    assert (got["t"]["count"], got["t"]["unique"], got["t"]["top"], got["t"]["freq"]) == (4, 2, "a", 2)
    assert got["t"]["mean"] is None and got["x"]["top"] is None
    assert (got["x"]["count"], got["x"]["p50"], got["x"]["max"]) == (3, 2.0, 4.0)


def test_bin_pivot_keeps_empty_bins_and_out_of_range_rows(frame):
    df = frame(
        "grade bigint, bin int, u bigint",
        [(1, 100, 7), (1, 100, 7), (1, 200, 8), (2, None, 9), (None, 100, 5), (3, 300, None)],
    )
    got = distinct_users_by_bin(df, "grade", "bin", "u", [100, 200, 300])
    assert rows_of(got) == [(1, 1, 1, 0), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_mean_drops_null_keys_and_groups_without_values(frame):
    df = frame("k int, a double, b double", [(1, 2.0, None), (1, 4.0, None), (2, None, None), (None, 1.0, 1.0)])
    assert rows_of(mean_by(df, ["k"], ["a", "b"])) == [(1, 3.0, None)]


def test_usage_pivot_zero_inside_a_frame_null_across(frame):
    cells = frame(
        "u string, period string, label string, v double",
        [("a", "pre", "x", 1.0), ("b", "pre", "y", 2.0), ("a", "non", "x", 5.0), ("c", "non", None, 9.0)],
    )
    got = usage_pivot(cells, ["u", "period"], ["period"], "label", "v", ["x", "y", "z"])
    assert rows_of(got) == [
        ("a", "non", 5.0, None, None),
        ("a", "pre", 1.0, 0.0, None),
        ("b", "pre", 0.0, 2.0, None),
    ]


def test_residual_join_blanks_but_keeps_rows(frame):
    rows = frame("id int, k int, h string", [(1, 1, "05"), (2, 1, "06"), (3, 2, None), (4, None, "05")])
    state = frame("k int, hh string, x int", [(1, "05", 9), (2, "05", 8)])
    got = m.left_with_residual(rows, state, ["k"], F.col("h") == F.col("hh"))
    assert rows_of(got, "id", "hh", "x") == [(1, "05", 9), (2, None, None), (3, None, None), (4, None, None)]


def test_merge_renames_only_what_overlaps(frame):
    left = frame("k int, a int, id int", [(1, 5, 1), (2, 6, 2), (None, 7, 3)])
    right = frame("k int, a int, b int", [(1, 50, 500), (None, 70, 700)])
    got = m.merge_renamed(left, right, "k", ["a", "b"], "_rr")
    assert set(got.columns) == {"k", "a", "id", "a_rr", "b"}
    assert rows_of(got, "k", "a", "a_rr", "b") == [(1, 5, 50, 500), (2, 6, None, None), (None, 7, None, None)]


def test_without_keys_keeps_null(frame):
    rows = frame("id int, k int", [(1, 1), (2, 2), (3, None)])
    assert rows_of(m.without_keys(rows, rows.filter("k = 1"), "k"), "id") == [(2,), (3,)]


def test_date_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(40).selectExpr("id", "concat('2025-12-', lpad(10 + id % 20, 2, '0')) AS date_ymd_kst").write.partitionBy(
        "date_ymd_kst"
    ).parquet(path)
    log = spark.read.schema("id bigint, date_ymd_kst string").parquet(path)
    df = date_partitions(log, since="2025-12-12", until="2025-12-13")
    assert df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_ymd_kst" in plan
    assert date_partitions(log, days=["2025-12-11"]).count() == 2
    assert date_partitions(log, after="2025-12-28").count() == 2
    hours = log.withColumn("hour_kst", F.lit("05")).filter(in_hours(("2025-12-12", 6), ("2025-12-14", 5)))
    assert "date_ymd_kst" in hours._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    assert {r[0] for r in hours.select("date_ymd_kst").collect()} == {"2025-12-13", "2025-12-14"}


def test_hour_edges(frame):
    df = frame(
        "date_ymd_kst string, hour_kst string",
        [("2025-12-23", "11"), ("2025-12-23", "12"), ("2025-12-24", "x"), ("2025-12-26", "11"), ("2025-12-26", "12"), ("2025-12-23", "x")],
    )
    got = df.filter(in_hours(("2025-12-23", 12), ("2025-12-26", 11)))
    assert rows_of(got) == [("2025-12-23", "12"), ("2025-12-24", "x"), ("2025-12-26", "11")]
    assert rows_of(df.filter(in_hours(("2025-12-23", 11), ("2025-12-23", 11)))) == [("2025-12-23", "11")]


def test_snapshots_latest_only(frame):
    df = frame("id int, date_ymd_snapshot string", [(1, "2025-12-10"), (1, "2025-12-11"), (1, "2025-12-12"), (2, "2025-12-11")])
    assert rows_of(snapshots(df, "2025-12-10", ["id"])) == [(1,), (1,), (2,)]
    assert rows_of(snapshots(df, "2025-12-10", ["id"], latest_only=True)) == [(1,)]


def test_csv_round_trip(spark, frame, tmp_path):
    df = frame(
        "user_id bigint, relative_score double, rcmd_cnt bigint, del_interval_hour double",
        [(1, 1.5, 10, 2.0), (2, None, 20, None), (3, float("nan"), None, 0.5)],
    )
    path = str(tmp_path / "counts")
    write_extract(df, path)
    typed, inferred = read_extract(spark, path, "exposure_counts"), read_extract(spark, path)
    want = [(1, 1.5, 10, 2.0), (2, None, 20, None), (3, None, None, 0.5)]
    assert rows_of(typed) == want and typed.dtypes == df.dtypes
    assert rows_of(inferred.select(*df.columns)) == want


def test_more_flags_than_one_mask_holds(frame):
    df = frame("k int, v int", [(1, i % 70) for i in range(140)])
    got = distinct_by_flags(df, ["k"], "v", {f"f{i}": f"v <= {i}" for i in range(70)}).first()
    assert [got[f"f{i}"] for i in range(70)] == [i + 1 for i in range(70)]


def test_a_label_without_column_is_an_error(frame):
    cells = frame("u int, period string, label string, v double", [(1, "p", "x", 1.0), (1, "p", "zz", 2.0)])
    with pytest.raises(Exception, match="no column for the label zz"):
        usage_pivot(cells, ["u", "period"], ["period"], "label", "v", ["x"]).collect()


def test_quantiles_take_infinity_and_leave_out_nan(frame):
    inf = float("inf")
    df = frame("k int, x double", [(1, v) for v in (1.0, 2.0, 3.0, inf, inf, -inf, float("nan"))])
    got = q.exact_quantiles(df, ["k"], "x", (0.0, 0.5, 1.0)).first()
    assert (got["n"], got["q_0"], got["q_1"], got["q_2"]) == (6, -inf, 2.5, inf)
    summary = describe_all(frame("x double, t string", [(1.0, "a"), (3.0, "a"), (float("nan"), "b")]), ["x"], ["t"])
    row = {r["column_name"]: r for r in summary.collect()}["x"]
    assert (row["count"], row["mean"], row["p50"], row["max"]) == (2, 2.0, 2.0, 3.0)


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_of_values_within_one_slice(spark, few):
    """A million instants of one slice, and neighbours that only the last pass tells apart."""
    hour = spark.range(1_000_000).select(
        F.lit(1).alias("k"), (F.col("id") * 3600 + 1_700_000_000_000_000).cast("double").alias("x")
    )
    totals = q.slice_totals(q.points(hour, ["k"], "x"), ["k"])
    assert totals.count() < 20
    got = q.exact_quantiles(hour, ["k"], "x", (0.25, 0.5), few).first()
    assert (got["n"], got["q_0"]) == (1_000_000, 1_700_000_000_000_000 + 3600 * 249_999.75)
    near = [1.0 + i * 2.0**-52 for i in range(50)] + [1.5] * 3
    df = spark.createDataFrame([(g, x) for g in (1, 2) for x in near], "g int, x double")
    for r in q.exact_quantiles(df, ["g"], "x", (0.1, 0.5, 0.9, 1.0), few).collect():
        assert [r[f"q_{i}"] for i in range(4)] == pytest.approx(list(np.quantile(near, (0.1, 0.5, 0.9, 1.0))), abs=1e-15)


def test_quantile_plans_shuffle_slices_only(spark, sf_dir):
    """Exchanges below the joins carry slices and parts; no different values before the last pass."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit(1).alias("k"), "l_extendedprice")
    n = lines.select("l_extendedprice").distinct().count()
    totals = q.slice_totals(q.points(lines, ["k"], "l_extendedprice"), ["k"])
    assert totals.count() < n / 2
    plan = q.exact_quantiles(lines, ["k"], "l_extendedprice", (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_too_many_groups_are_an_error_not_a_broadcast(spark):
    from cohortlens.operators.bounded import held

    few = spark.range(10)
    assert held(few, 10).count() == 10
    with pytest.raises(Exception, match="more than 9 rows to broadcast; take the other way"):
        few.join(held(few, 9, "take the other way"), "id").collect()


def test_csv_cells_survive_other_readers(spark, frame, tmp_path):
    import duckdb

    cells = ['a "q", b', "two\nlines", "plain", "comma, only", 'back\\"slash']
    df = frame("n int, t string", list(enumerate(cells)))
    path = str(tmp_path / "out")
    write_extract(df.coalesce(1), path)
    theirs = duckdb.sql(f"SELECT n, t FROM read_csv('{path}/*.csv', header = true, quote = '\"', escape = '\"') ORDER BY n").fetchall()
    assert theirs == list(enumerate(cells))
    other = str(tmp_path / "other.csv")
    duckdb.sql(f"COPY (SELECT * FROM read_csv('{path}/*.csv', header = true)) TO '{other}' (HEADER, QUOTE '\"', ESCAPE '\"')")
    assert rows_of(read_extract(spark, other, multi_line=True), "n", "t") == rows_of(df, "n", "t")
    (tmp_path / "long.csv").write_text("n,t\n1,a,extra\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_extract(spark, str(tmp_path / "long.csv")).collect()


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_csv_of_quoted_breaks_is_read_by_many_tasks(spark, tmp_path, split):
    from pyspark.sql.types import StructType

    from cohortlens.sources.csv_records import csv_records, read_checked

    def quoted(x):
        return '"' + x.replace('"', '""') + '"'

    texts = ["plain", 'two\nlines, "quoted"', "", "\n\n", "x" * 300 + "\n" + "y" * 300, 'ends "', "é\n\r\nü"] * 9
    rows = [f"{i},{quoted(t)},{i}.5" for i, t in enumerate(texts)]
    (tmp_path / "a.csv").write_text("n,t,unused\n" + "\n".join(rows) + "\n", newline="")
    (tmp_path / "b.csv").write_text('n,t,unused\n1000,x,NaN\n1001,too,many,cells\nword,y,1\n\n1002,"never\nends,1\n', newline="")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = csv_records(spark, str(tmp_path))
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        assert split > 64 or tasks > 30
        assert records.count() == 2 + len(texts) + 5
        good, bad = read_checked(spark, str(tmp_path), StructType.fromDDL("t string, n bigint"))
        want = [(t.replace("\r\n", "\n") or None, i) for i, t in enumerate(texts)] + [("x", 1000)]
        assert sorted(map(tuple, good.collect()), key=lambda r: r[1]) == want
        assert sorted(r["reason"] for r in bad.collect()) == ["a quote never ends", "not of its type: n", "other cells than the header"]
        with pytest.raises(ValueError, match="no column m"):
            read_checked(spark, str(tmp_path), StructType.fromDDL("m int"))
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
