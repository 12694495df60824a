"""A/B readout per group and hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.measures import percent
from cohortlens.operators.funnel import SPECIAL_TYPES
from cohortlens.sources.scans import in_hours

# Experiment window, focus type, minimum group size, genders, map key.
START = ("2025-12-23", 12)
END = ("2025-12-26", 11)
FOCUS_TYPE = 80
MIN_USERS = 5
GENDERS = (0, 1)
MODEL_KEY = "ml_ver"


def ab_readout(
    log: DataFrame,
    start: tuple[str, int] = START,
    end: tuple[str, int] = END,
    types: Sequence[int] = tuple(SPECIAL_TYPES),
    focus_type: int = FOCUS_TYPE,
    min_users: int = MIN_USERS,
    genders: tuple[int, int] = GENDERS,
    match_since: str | None = None,
    match_date: bool = False,
) -> DataFrame:
    """Counts, ratios and mean distances per (user1 id mod 2, hour).

    A recommendation row also counts as requested or matched when the pair's latest
    state says so: the pair's maxima of request time, accept time, hour, day and type
    over everything since ``match_since`` (default: the first day), used where the
    maximal hour equals the row's hour and the maximal type differs from the row's
    type. The day of that state has to exist but, unless ``match_date``, need not be
    the row's day. Groups need more than ``min_users`` users.

    The log is aggregated once to (pair, hour, type) cells that hold both sides of
    that comparison, so raw rows are combined before the shuffle and no self-join is
    left; a pair has at most hours x types cells.
    """
    since = match_since or start[0]
    in_test = (
        in_hours(start, end)
        & F.col("rcmd_type").isin(list(types))
        & (F.col("user1_gender") == genders[0])
        & (F.col("user2_gender") == genders[1])
    )
    rows = log.filter(F.col("date_ymd_kst") >= min(since, start[0])).withColumns(
        {"_in_state": F.col("date_ymd_kst") >= since, "_in_test": in_test}
    )
    per_user = _per_user(_cells(rows, match_date), focus_type, match_date)
    group = F.col("user1_id") % 2
    rule_based = (
        rows.filter(F.col("_in_test") & F.col("exp_props")[MODEL_KEY].isNull())
        .groupBy(group.alias("_group"), F.col("hour_kst").alias("_hour"))
        .agg(F.count_distinct(F.col("registered_time")).alias("_rb"))
    )
    sums = per_user.groupBy(group.alias("user1_group"), "hour_kst").agg(
        F.count("user1_id").alias("user_cnt"), *[F.sum(m).alias(m) for m in _SUMS]
    )
    joined = sums.filter(F.col("user_cnt") > min_users).join(
        rule_based,
        (F.col("user1_group") == F.col("_group")) & F.col("hour_kst").eqNullSafe(F.col("_hour")),
        "left",
    )
    focus = F.col("og_booster_cnt")
    return joined.select(
        "user1_group",
        "hour_kst",
        "user_cnt",
        "all_rcmd_cnt",
        F.coalesce("_rb", F.lit(0)).alias("rb_rcmd_cnt"),
        "all_rcmd_friend_request_cnt",
        "all_rcmd_match_cnt",
        "all_rcmd_like_cnt",
        "og_booster_cnt",
        "og_booster_like_cnt",
        "og_booster_friend_request_cnt",
        "og_booster_match_cnt",
        percent(F.col("_liked"), focus).alias("og_booster_like_ratio"),
        percent(F.col("og_booster_friend_request_cnt"), focus).alias(
            "og_booster_friend_request_ratio"
        ),
        percent(F.col("og_booster_match_cnt"), focus).alias("og_booster_match_ratio"),
        _km("_dist").alias("og_booster_distance"),
        _km("_like_dist").alias("og_booster_like_distance"),
        _km("_request_dist").alias("og_booster_friend_request_distance"),
    ).orderBy(F.desc_nulls_last("user1_group"), F.asc_nulls_last("hour_kst"))


# Sums over the test rows of a user and hour, as SQL over the cells.
_SUMS = {
    "all_rcmd_cnt": "_n",
    "all_rcmd_friend_request_cnt": "CASE WHEN _requested THEN _n ELSE _n_request END",
    "all_rcmd_match_cnt": "CASE WHEN _accepted THEN _n ELSE _n_accept END",
    "all_rcmd_like_cnt": "_n_like",
    "og_booster_cnt": "CASE WHEN _focus THEN _n ELSE 0 END",
    "og_booster_like_cnt": "CASE WHEN _focus THEN _n_like_time ELSE 0 END",
    "og_booster_friend_request_cnt": "CASE WHEN _focus AND _requested THEN _n ELSE 0 END",
    "og_booster_match_cnt": "CASE WHEN _focus AND _accepted THEN _n ELSE 0 END",
    "_liked": "CASE WHEN _focus THEN _n_like ELSE 0 END",
    "_dist_sum": "CASE WHEN _focus THEN _d END",
    "_dist_n": "CASE WHEN _focus THEN _d_n END",
    "_like_dist_sum": "CASE WHEN _focus THEN _d_like END",
    "_like_dist_n": "CASE WHEN _focus THEN _d_like_n END",
    "_request_dist_sum": "CASE WHEN _focus AND _requested THEN _d END",
    "_request_dist_n": "CASE WHEN _focus AND _requested THEN _d_n END",
}

# What a cell holds: the state maxima and the counts over its test rows.
_CELL = {
    "_state": "max(_in_state)",
    "_request": "max(CASE WHEN _in_state THEN friend_request_time END)",
    "_accept": "max(CASE WHEN _in_state THEN other_accepted_time END)",
    "_rows": "count(CASE WHEN _in_test THEN 1 END)",
    "_n": "count(CASE WHEN _in_test THEN registered_time END)",
    "_n_request": "count(CASE WHEN _in_test AND friend_request_time IS NOT NULL THEN registered_time END)",
    "_n_accept": "count(CASE WHEN _in_test AND other_accepted_time IS NOT NULL THEN registered_time END)",
    "_n_like": "count(CASE WHEN _in_test AND like_time IS NOT NULL THEN registered_time END)",
    "_n_like_time": "count(CASE WHEN _in_test THEN like_time END)",
    "_d": "sum(CASE WHEN _in_test THEN min_distance END)",
    "_d_n": "count(CASE WHEN _in_test THEN min_distance END)",
    "_d_like": "sum(CASE WHEN _in_test AND like_time IS NOT NULL THEN min_distance END)",
    "_d_like_n": "count(CASE WHEN _in_test AND like_time IS NOT NULL THEN min_distance END)",
}


def _km(name: str) -> Column:
    return F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n")) / 1000


def _cells(rows: DataFrame, match_date: bool) -> DataFrame:
    """One row per (pair, hour, type), and day where days are to be matched."""
    keys = ["user1_id", "user2_id", "hour_kst", "rcmd_type"]
    if match_date:
        keys.append("date_ymd_kst")
    return rows.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in _CELL.items()])


def _per_user(cells: DataFrame, focus_type: int, match_date: bool) -> DataFrame:
    """Cells joined to their pair's state by window, then summed per (user1, hour)."""
    pair = Window.partitionBy("user1_id", "user2_id")
    compared = ["hour_kst", "rcmd_type", "_request", "_accept"] + ["date_ymd_kst"] * match_date
    latest = {
        f"_last_{c}": F.max(F.expr(f"CASE WHEN _state THEN {c} END")).over(pair) for c in compared
    }
    matched = (
        "user1_id IS NOT NULL AND user2_id IS NOT NULL"
        " AND hour_kst = _last_hour_kst AND rcmd_type <> _last_rcmd_type"
    )
    if match_date:
        matched += " AND date_ymd_kst = _last_date_ymd_kst"
    seen = cells.withColumns(latest).filter("_rows > 0")
    marked = seen.withColumns(
        {
            "_requested": F.expr(f"{matched} AND _last__request IS NOT NULL"),
            "_accepted": F.expr(f"{matched} AND _last__accept IS NOT NULL"),
            "_focus": F.col("rcmd_type") == focus_type,
        }
    )
    return marked.groupBy("user1_id", "hour_kst").agg(
        *[F.expr(f"sum({e})").alias(n) for n, e in _SUMS.items()]
    )
