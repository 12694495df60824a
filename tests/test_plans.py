"""The composed jobs on hand-written frames, with results worked out by hand."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.operators.funnel import two_sided_funnel
from cohortlens.operators.periods import clean_use_type, first_purchases, label_periods
from cohortlens.plans import early_response as er
from cohortlens.plans import reward_cohort as rw
from cohortlens.plans import usage_periods as up
from cohortlens.plans.ab_readout import ab_readout
from cohortlens.plans.channel_lookup import channel_lookup
from cohortlens.plans.exposure_curves import exposure_curves
from cohortlens.plans.exposure_histogram import exposure_histogram
from cohortlens.plans.exposure_timeline import RESPONSE_TIME, exposure_timeline
from cohortlens.plans.first_reward_daily import first_reward_daily
from cohortlens.sources import extract_sets as sets
from cohortlens.sources.schemas import EXTRACTS, TABLES
from cohortlens.sources.tables import read_table
from tests.conftest import rows_of


@pytest.fixture
def table(spark):
    """A known table from dicts; missing columns are NULL, instants and dates are text."""

    def build(name: str, rows: list[dict], schemas=TABLES):
        schema = StructType.fromDDL(schemas[name])
        texts = {f.name for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"}
        raw = ", ".join(
            f"{f.name} {'string' if f.name in texts else f.dataType.simpleString()}"
            for f in schema.fields
        )
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
        df = spark.createDataFrame(data, raw)
        return df.select([F.col(f.name).cast(f.dataType) for f in schema.fields])

    return build


def log_row(user1, user2, time, **more):
    return {
        "user1_id": user1, "user2_id": user2, "registered_time": time, "date_ymd_kst": time[:10],
        "hour_kst": time[11:13], "user1_gender": 1, "user1_relative_score": 50.0,
    } | more


def test_timeline_grid_sums_and_edges(table):
    users = table("accounts", [
        {"id": 1, "gender": 1, "relative_score": 40.0, "location": "12345",
         "first_approval_time": "2025-12-01 00:00:00", "approval_time": "2025-12-01 00:00:00"},
        {"id": 2, "gender": 1, "relative_score": 70.0, "first_approval_time": "2025-12-02 00:00:00",
         "approval_time": "2025-12-02 00:00:00"},
        {"id": 3, "gender": 0, "relative_score": 70.0, "first_approval_time": "2025-12-02 00:00:00",
         "approval_time": "2025-12-02 00:00:00"},
        {"id": 4, "gender": 1, "relative_score": 70.0, "first_approval_time": "2026-01-02 00:00:00",
         "approval_time": "2026-01-02 00:00:00"},
    ])
    at = "2025-12-01 00:{:02d}:00"
    log = table("recommendation_log", [
        log_row(1, 10, at.format(1), impression_time=at.format(2), rcmd_type=3, channel_id=3),
        log_row(1, 10, at.format(30), impression_time=at.format(31)),          # later, same pair
        log_row(1, 11, at.format(3), impression_time=at.format(4), like_time=at.format(12)),
        log_row(1, 12, at.format(3)),                                          # never shown
        log_row(1, 13, at.format(5), impression_time="2025-11-30 23:57:00"),   # -3 minutes: bucket 0
        log_row(1, 14, at.format(5), impression_time="2025-11-30 23:50:00"),   # -10 minutes: none
        log_row(1, 15, at.format(6), impression_time="2025-12-02 00:00:00"),   # last bucket 288
        log_row(1, 16, at.format(6), impression_time="2025-12-02 00:05:00"),   # beyond
        log_row(1, None, at.format(7), impression_time=at.format(8)),          # unknown counterpart
        log_row(3, 10, at.format(1), impression_time=at.format(1)),
    ])
    timeline = exposure_timeline(log, users).cache()
    assert {r["user_id"]: r["count"] for r in timeline.groupBy("user_id").count().collect()} == {1: 289 + 0, 2: 289}
    one = {r["min_rc"]: r for r in timeline.filter("user_id = 1").collect()}
    assert set(one) == set(range(289))
    assert (one[0]["rcmd_users"], one[0]["rcmd_users_rcmded"], one[0]["rcmd_response_users"]) == (3, 1, 1)
    assert (one[1]["rcmd_users"], one[1]["hour_kst"], one[1]["cumul_rcmd_users"]) == (0, "00", 3)
    assert (one[2]["rcmd_users"], one[2]["hour_kst"], one[2]["cumul_rcmd_users"]) == (0, None, 3)
    assert (one[288]["rcmd_users"], one[288]["cumul_rcmd_impression_users"]) == (1, 4)
    assert (one[0]["user_location"], one[0]["relative_score"]) == ("123", 40.0)
    assert timeline.filter("user_id = 2").agg(F.max("cumul_rcmd_users")).first()[0] == 0

    by_response = exposure_timeline(log, users, event_time=RESPONSE_TIME)
    two = {r["min_rc"]: r["cumul_rcmd_users"] for r in by_response.filter("user_id = 1").collect()}
    assert (two[1], two[2], two[288]) == (0, 1, 1)

    curves = exposure_curves(timeline, "relative_score", ["cumul_rcmd_users"])
    got = {(r["grade"], r["grade_label"], r["time"]): r["cumul_rcmd_users"] for r in curves.collect()}
    assert got[("2", "30-60%", 1440)] == 4.0 and got[("3", "60-90%", 0)] == 0.0 and len(got) == 578


def test_timeline_two_rows_in_one_bucket(table, no_broadcast):
    users = table("accounts", [{"id": 1, "gender": 1, "relative_score": 40.0,
        "first_approval_time": "2025-12-01 00:00:00", "approval_time": "2025-12-01 00:00:00"}])
    log = table("recommendation_log", [
        log_row(1, 10, "2025-12-01 00:00:10", impression_time="2025-12-01 00:06:00"),
        log_row(1, 11, "2025-12-01 01:00:10", impression_time="2025-12-01 00:07:00"),
        log_row(1, 12, "2025-12-01 01:00:10", impression_time="2025-12-01 00:07:00", user1_relative_score=100.0),
    ])
    rows = exposure_timeline(log, users).filter("min_rc BETWEEN 0 AND 2")
    assert rows_of(rows, "min_rc", "hour_kst", "rcmd_users", "cumul_rcmd_users") == [
        (0, None, 0, 0), (1, "00", 1, 1), (1, "01", 1, 2), (2, None, 0, 2),
    ]


def test_funnel_windows_and_missing_sides(table):
    cohort = table("activation_metrics", [
        {"user_id": 1, "first_approval_time": "2025-12-01 00:00:00"},
        {"user_id": 2, "first_approval_time": "2025-12-01 00:00:00"},
        {"user_id": 3, "first_approval_time": "2025-12-01 00:00:00"},
    ])
    early, edge, after = "2025-11-30 00:00:00", "2025-12-09 00:59:59", "2025-12-09 01:00:00"
    last, past = "2025-12-16 00:59:59", "2025-12-16 01:00:00"
    log = table("recommendation_log", [
        log_row(1, 2, early, joined_time=early, rcmd_type=3, channel_id=1, profile_open_time=edge),
        log_row(1, 2, early, joined_time=early),                       # same pair again
        log_row(1, 5, edge, joined_time=edge, dislike_time=after, like_time=edge),
        log_row(1, 6, after, joined_time=last),
        log_row(1, 7, after, joined_time=past),
        log_row(1, None, early, joined_time=early),
        log_row(9, 3, early, joined_time=early, friend_request_time=edge),   # 3 is only a candidate
        log_row(9, 2, early, profile_open_time=edge, rcmd_type=80, channel_id=1),
        log_row(8, 2, early, profile_open_time=edge, rcmd_type=3, channel_id=21),
        log_row(2, None, early),
    ])
    funnel = {r["user_id"]: r.asDict() for r in two_sided_funnel(log, cohort).collect()}
    assert set(funnel) == {1, 2}
    one, two = funnel[1], funnel[2]
    assert (one["rcmd_regi"], one["rcmd_resp"], one["rcmd_join_10d"]) == (2, 1, 2)
    assert one["rcmd_other_regi"] is None and one["rcmd_join"] is None and one["rcmd_join_14d"] is None
    assert (two["rcmd_regi"], two["rcmd_other_regi"], two["rcmd_other_profile"]) == (0, 3, 1)
    assert (two["rcmd_join"], two["rcmd_join_14d"], two["rcmd_other_profile_14d"]) == (1, 0, 1)
    with pytest.raises(ValueError):
        two_sided_funnel(log, cohort, late=(0, 5))


def test_cohort_bounds_are_instants(table):
    metrics = table("activation_metrics", [
        {"user_id": i, "first_approval_time": t, "last_active_at": "2025-12-31 00:00:00"}
        for i, t in enumerate(["2025-11-30 14:59:59", "2025-11-30 15:00:00", "2025-12-30 15:00:00", "2025-12-30 15:00:01"])
    ])
    assert rows_of(rw.sign_up_cohort(metrics), "user_id") == [(1,), (2,)]


def test_reward_cohort_null_and_zero(table):
    metrics = table("activation_metrics", [
        {"user_id": i, "gender": g, "first_approval_time": "2025-12-05 20:00:00", "last_active_at": "2025-12-06 20:59:59"}
        for i, g in [(1, 1), (2, 1), (3, 0), (4, 1)]
    ])
    accounts = table("accounts", [{"id": i, "relative_score": s} for i, s in [(1, 10.0), (2, 99.0), (3, 10.0), (4, 100.0)]])
    screens = table("screen_log", [
        {"user_id": 1, "navigations": ["home", "mobile_coupon"], "date_ymd_kst": "2025-12-07"},
        {"user_id": 1, "navigations": None, "date_ymd_kst": "2025-12-07"},
        {"user_id": 1, "navigations": ["mobile_coupon_x"], "date_ymd_kst": "2025-12-14"},
    ])
    box = table("coupon_box", [
        {"id": 1, "assigned_user_id": 1, "created_at": "2025-12-06 00:00:00"},
        {"id": 2, "assigned_user_id": 1, "created_at": "2025-11-30 14:59:59", "received_at": "2025-12-06 00:00:00"},
    ])
    code = table("coupon_code", [
        {"id": 1, "assigned_user_id": 1, "source_id": 1, "status": "USED", "valid_from": "2025-12-06 00:00:00"},
        {"id": 1, "assigned_user_id": 1, "source_id": 1, "status": "USED", "valid_from": "2025-12-06 00:00:00"},
        {"id": 2, "assigned_user_id": 1, "source_id": 9, "status": "USED", "valid_from": "2025-12-06 00:00:00"},
        {"id": 3, "assigned_user_id": 1, "source_id": 1, "status": "USED"},
        {"id": 4, "assigned_user_id": 1, "source_id": 1, "status": "ISSUED", "valid_from": "2025-12-06 00:00:00"},
    ])
    source = table("coupon_source", [{"id": 1, "coupon_name": "x 아메리카노 1잔 2일차 y"}])
    log = table("recommendation_log", [])
    rows = {r["user_id"]: r for r in rw.reward_cohort(metrics, accounts, log, screens, box, code, source).collect()}
    assert set(rows) == {1, 2}
    one, two = rows[1], rows[2]
    assert str(one["approval_date"]) == "2025-12-06" and one["retention_hour"] == 24
    assert (one["issue_cnt"], one["redeem_cnt"], one["check_coupon_box"]) == (1, 0, 1)
    assert (one["d1_retention"], one["d2_4_retention"], one["w1_retention"], one["online_date"]) == (1, 0, 1, 1)
    assert (one["counts_1d_am"], one["counts_2d_am"], one["rcmd_regi"]) == (0, 1, None)
    assert (two["issue_cnt"], two["redeem_cnt"], two["counts_2d_am"], two["d1_retention"]) == (None, 0, None, None)

    raw = {r["user_id"]: r for r in rw.reward_cohort_raw(
        metrics, accounts, screens, code, since="2025-12-01 00:00:00", log_since="2025-12-01", screen="mobile_coupon"
    ).collect()}
    assert set(raw) == {1, 2, 3, 4}
    assert (raw[1]["get_vana_coupon"], raw[1]["used_vana_coupons"]) == (1, 2)
    assert (raw[2]["get_vana_coupon"], raw[2]["used_vana_coupons"]) == (0, None)


def ab_row(user1, user2, time, kind, **more):
    return log_row(user1, user2, time, rcmd_type=kind, user1_gender=0, user2_gender=1,
                   min_distance=2000.0, exp_props={"ml_ver": "1"}) | more


def test_ab_readout(table):
    hour, day2 = "2025-12-23 13:00:00", "2025-12-24 13:30:00"
    log = table("recommendation_log", [
        ab_row(2, 100, hour, 80, like_time=hour),
        ab_row(2, 100, day2, 101, friend_request_time=day2, date_ymd_kst="2025-12-24"),
        ab_row(4, 100, hour, 80, exp_props={"other": "1"}),
        ab_row(4, 101, hour, 80, exp_props=None),
        ab_row(6, None, hour, 80),
        ab_row(1, 100, hour, 4),
        ab_row(3, 100, hour, 4),
        ab_row(2, 102, "2025-12-23 11:59:00", 80),
        ab_row(2, 103, hour, 3),
        ab_row(2, 104, hour, 80, user2_gender=0),
    ])
    rows = {r["user1_group"]: r for r in ab_readout(log, min_users=1).collect()}
    assert set(rows) == {0, 1}
    even = rows[0]
    assert (even["hour_kst"], even["user_cnt"], even["all_rcmd_cnt"], even["rb_rcmd_cnt"]) == ("13", 3, 5, 1)
    # the pair (2, 100) has maximal type 101, so its type-80 row takes over the request
    assert (even["all_rcmd_friend_request_cnt"], even["og_booster_friend_request_cnt"]) == (2, 1)
    assert (even["og_booster_cnt"], even["og_booster_like_cnt"]) == (4, 1)
    assert (str(even["og_booster_like_ratio"]), even["og_booster_distance"]) == ("25.0", 2.0)
    odd = rows[1]
    assert odd["og_booster_cnt"] == 0 and odd["og_booster_like_ratio"] is None and odd["og_booster_distance"] is None
    dated = {r["user1_group"]: r for r in ab_readout(log, min_users=1, match_date=True).collect()}
    assert dated[0]["og_booster_friend_request_cnt"] == 0
    assert [r["user1_group"] for r in ab_readout(log, min_users=2).collect()] == [0]


def test_first_reward_daily(table):
    metrics = table("activation_metrics", [
        {"user_id": 1, "gender": 0, "first_approval_time": "2025-06-01 23:59:59", "ci_hash_user_seq": 1},
        {"user_id": 2, "gender": 0, "first_approval_time": "2025-06-01 00:00:00", "mobile_hash_user_seq": 1, "ci_hash_user_seq": 2},
        {"user_id": 3, "gender": 1, "first_approval_time": "2025-06-01 00:00:00", "ci_hash_user_seq": 1},
        {"user_id": 4, "gender": 0, "first_approval_time": "2025-07-01 12:00:00"},
        {"user_id": 5, "gender": 0, "first_approval_time": "2025-07-02 00:00:00"},
    ])
    kind = "MALE_NEW_USER_FIRST_JOIN_V1"
    grants = table("reward_grant", [{"user_id": 1, "source_type": kind}] * 2 + [{"user_id": 2, "source_type": "X"}])
    got = [tuple(str(v) for v in r) for r in first_reward_daily(metrics, grants).collect()]
    assert got == [
        ("2025-06-01", "2", "1", "1", "1", "1", "1", "1"),
        ("2025-07-01", "1", "0", "0", "0", "0", "0", "0"),
    ]


def test_channel_lookup(table):
    day = "2025-12-11"
    daily = table("channel_daily", [
        {"channel_id": 1, "rcmd_type": 3, "date_ymd_kst": day}, {"channel_id": 1, "rcmd_type": 3, "date_ymd_kst": day},
        {"channel_id": 2, "rcmd_type": 9, "date_ymd_kst": day}, {"channel_id": 7, "rcmd_type": 3, "date_ymd_kst": "2025-12-10"},
    ])
    kinds = table("type_map", [{"rcmd_type": 3, "rcmd_type_name": "three"}])
    names = table("channel_snapshot", [
        {"id": 1, "name": "0123456789abcdef105tail", "date_ymd_snapshot": d} for d in ("2025-12-11", "2025-12-12")
    ])
    places = table("place_snapshot", [{"id": 105, "title": "hall", "date_ymd_snapshot": day}])
    got = [tuple(r) for r in channel_lookup(daily, kinds, names, places).collect()]
    assert got == [(1, 3, "three", "0123456789abcdef105tail", "hall"), (2, None, None, None, None)]


def usage(table, rows):
    base = {"get_referral_reward": 0, "relative_score": 35.0, "user_group": "A", "use_type": "x", "description": "d"}
    return table("usage_log", [base | r for r in rows], EXTRACTS)


def test_periods_around_the_first_purchase(table, no_broadcast):
    steps = [4, 5, 6, 15, 16, 25, 26]
    log = usage(table, [{"ci_hash": "p", "action_num": a, "quantity": -1.0} for a in steps]
                + [{"ci_hash": "p", "action_num": 5, "quantity": 9.0, "purchase_num": 1.0},
                   {"ci_hash": "p", "action_num": 8, "quantity": 9.0, "purchase_num": 1.0},
                   {"ci_hash": "n", "action_num": 1, "quantity": 0.0, "use_type": None},
                   {"ci_hash": "n", "action_num": 2, "quantity": None},
                   {"ci_hash": "n", "action_num": 3, "quantity": -2.0, "description": None},
                   {"ci_hash": None, "action_num": 3, "quantity": -2.0},
                   {"ci_hash": "r", "action_num": 3, "quantity": -2.0, "get_referral_reward": 1}])

    labelled = label_periods(up.without_referral(log), "user_group", "ci_hash")
    assert rows_of(labelled, "ci_hash", "action_num", "period") == [
        ("n", 1, "non"), ("n", 3, "non"), ("p", 15, "post_10"), ("p", 16, "post_20"),
        ("p", 25, "post_20"), ("p", 4, "pre"), ("p", 6, "post_10"),
    ]
    every = label_periods(up.without_referral(log), "user_group", "ci_hash", every=True)
    assert every.filter("ci_hash = 'p' AND action_num = 4").count() == 2
    long = up.usage_before_after_purchase(log)
    assert ("A", "n", "non", "Other", "d", 1, 0.0) in rows_of(long)
    assert rows_of(up.purchaser_counts(log)) == [("A", 1)]
    assert rows_of(up.user_grades(log)) == [("n", 4), ("p", 4)]
    wide = up.usage_wide(long, "freq", ["x|d", "Other|d"])
    assert ("A", "p", "pre", 1, None) in rows_of(wide) and ("A", "n", "non", None, 1) in rows_of(wide)


def test_usage_extracts(spark, table, tmp_path):
    log = usage(table, [
        {"ci_hash": "p", "action_num": 1, "quantity": -1.0, "description": "a"},
        {"ci_hash": "p", "action_num": 2, "quantity": 5.0, "purchase_num": 1.0},
        {"ci_hash": "p", "action_num": 3, "quantity": -2.0},
        {"ci_hash": "q", "action_num": 1, "quantity": -4.0, "user_group": "B"},
    ])
    out = str(tmp_path / "extracts")
    up.write_usage_extracts(log, out)

    def lines(name):
        folder = sets.published(spark, out)[name]
        return sorted(line for f in Path(folder).glob("part-*") for line in f.read_text().splitlines())

    def extract(name):
        df = sets.read_published(spark, out, name)
        return df.columns, rows_of(df)

    assert extract("a_all_vol_periods") == (
        ["use_type|description", "ci_hash", "x|a", "x|d", "period"],
        [("0", "p", "1.0", None, "pre"), ("0", "p", None, "2.0", "post_10")],
    )
    assert set(lines("a_all_vol_periods")) == {
        "use_type,ci_hash,x,x,period", "description,,a,d,", "0,p,,2.0,post_10", "0,p,1.0,,pre",
    }
    assert lines("a_pre_freq") == ["ci_hash,", "description,a", "p,1", "use_type,x"]
    assert extract("b_non_vol") == (["use_type|description|ci_hash", "x|d"], [("q", "4.0")])
    grades = extract("user_grade")[1]
    assert sorted(r[0] for r in grades) == ["0", "1"] and sorted(r[1:] for r in grades) == [("p", "4"), ("q", "4")]
    assert not list(Path(out).glob("work-*"))

    first = sets.published(spark, out)
    broken = {"good": sets.Extract(spark.range(3)), "bad": sets.Extract(spark.range(3).selectExpr("raise_error('no') AS x"))}
    with pytest.raises(Exception, match="no"):
        sets.write_set(spark, out, broken)
    assert sets.published(spark, out) == first and len(list(Path(out, "sets").iterdir())) == 1
    assert extract("b_non_vol")[1] == [("q", "4.0")]
    for _ in range(3):
        sets.write_set(spark, out, {"empty": sets.Extract(spark.range(0)), "odd": sets.Extract(spark.createDataFrame([('a"b,c', None), ("x\ny", " z ")], "a string, b string"))})
    assert len(list(Path(out, "sets").iterdir())) == sets.KEPT
    assert extract("empty") == (["id"], []) and extract("odd")[1] == [('a"b,c', None), ("x\ny", " z ")]


def test_use_type_cleaning_is_optional(frame):
    plain = frame("a int", [(1,)])
    assert clean_use_type(plain).columns == ["a"]
    named = frame("use_type string", [("타임어택권",), (None,)])
    assert rows_of(clean_use_type(named)) == [("Other",), ("친구 신청권",)]


def test_first_purchases_ignore_unknown_users(frame):
    log = frame("g string, u string, action_num bigint, purchase_num double", [("A", None, 1, 1.0), ("A", "x", 3, 1.0), ("A", "x", 2, None)])
    assert rows_of(first_purchases(log, ["g", "u"])) == [("A", "x", 3)]


def test_histogram_modes(table):
    df = table("exposure_counts", [
        {"user_id": 1, "relative_score": 10.0, "rcmd_cnt": 50, "del_interval_hour": 1.0},
        {"user_id": 1, "relative_score": 10.0, "rcmd_cnt": 950, "del_interval_hour": 30.0},
        {"user_id": 2, "relative_score": 40.0, "rcmd_cnt": 5000, "del_interval_hour": 1.0},
        {"user_id": 3, "relative_score": None, "rcmd_cnt": 10, "del_interval_hour": 1.0},
        {"user_id": 4, "relative_score": 10.0, "rcmd_cnt": None, "del_interval_hour": 1.0},
    ], EXTRACTS)

    def cells(**options):
        return {r["grade"]: (r["bin_100"], r["bin_1000"]) for r in exposure_histogram(df, **options).collect()}

    assert cells() == {1: (1, 1), 2: (0, 0)}
    assert cells(mode="max_per_user") == {1: (0, 1), 2: (0, 0)}
    assert cells(mode="max_per_user", max_interval=24) == {1: (1, 0), 2: (0, 0)}
    with pytest.raises(ValueError):
        exposure_histogram(df, mode="min")


def test_early_response(table):
    rc = table("early_exposure", [
        {"user2_id": i, "min_rc": 2, "cumul_rcmd_users": c, "cumul_rcmd_2way_response_users": 0}
        for i, c in [(1, 50), (2, 99), (3, 100), (4, 3100), (5, 60)]
    ] + [{"user2_id": 1, "min_rc": 1, "cumul_rcmd_users": 5}], EXTRACTS)
    rr = table("early_response", [
        {"user2_id": 1, "min_rr": 1, "cumul_rcmd_2way_response_users": 90},
        {"user2_id": 1, "min_rr": 2, "cumul_rcmd_2way_response_users": 4},
        {"user2_id": 1, "min_rr": 3, "cumul_rcmd_2way_response_users": 99},
        {"user2_id": 2, "min_rr": 0, "cumul_rcmd_2way_response_users": 8},
        {"user2_id": 3, "min_rr": 2, "cumul_rcmd_2way_response_users": 0},
        {"user2_id": 4, "min_rr": 2, "cumul_rcmd_2way_response_users": 7},
    ], EXTRACTS)
    merged = er.early_exposure_response(rc, rr)
    assert rows_of(merged, "user2_id", er.RESPONSES_RR) == [(1, 4), (2, 8), (3, 0), (4, 7), (5, 0)]
    assert [r["user2_id"] for r in er.top_responders(rc, rr, n=3).collect()] == [2, 4, 1]
    boxes = {r["bin_idx"]: r for r in er.response_boxes(merged).collect()}
    assert len(boxes) == 31 and boxes[0]["median"] == 6.0 and boxes[1]["median"] is None


def test_tables_read_with_their_declared_schema(spark, tmp_path):
    spark.sql("SELECT 1L AS user_id, 'X' AS source_type").write.parquet(str(tmp_path / "reward_grant"))
    assert rows_of(read_table(spark, "reward_grant", str(tmp_path))) == [(1, "X")]
