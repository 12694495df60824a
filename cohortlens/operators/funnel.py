"""Two-sided recommendation funnel with hour windows since approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.distincts import flag_bit, flag_mask

# Windows in hours since first approval, and the recommendation
# types and channel whose profile opens do not count.
SHORT_WINDOW = 24 * 8
TEN_DAYS = 24 * 10
LATE_WINDOW = (24 * 8, 24 * 15)
SPECIAL_TYPES = [4, 50, 80, 101, 102, 103, 105]
EXCLUDED_CHANNEL = 21

_USED = [
    "registered_time",
    "profile_open_time",
    "impression_time",
    "like_time",
    "dislike_time",
    "friend_request_time",
    "other_accepted_time",
    "joined_time",
    "rcmd_type",
    "channel_id",
]


def _elapsed(hours: int) -> Column:
    return F.expr(f"first_approval_time + INTERVAL '{hours}' HOUR")


def two_sided_funnel(
    log: DataFrame,
    cohort: DataFrame,
    short: int = SHORT_WINDOW,
    ten_days: int = TEN_DAYS,
    late: tuple[int, int] = LATE_WINDOW,
    special_types: list[int] = SPECIAL_TYPES,
    excluded_channel: int = EXCLUDED_CHANNEL,
    log_by_candidate: DataFrame | None = None,
) -> DataFrame:
    """Distinct counterparts per stage for cohort users, as receiver and as candidate.

    ``cohort`` is (``user_id``, ``first_approval_time``). A user who only ever was a
    candidate (side 2) has no row; one who never was has NULL on that side and in the
    sums of both sides. Windows count complete hours: "at most 192" is anything before
    the 193rd hour is over, also before the approval, and hour 192 belongs to the
    late window as well. So each window is a pair of instants per cohort user, and
    rows only compare times.

    The log is joined to the cohort once on either side, so that rows of other users
    are gone before anything is stacked; then it is reduced to one mask of flags per
    (user, side, counterpart), and the bits are summed.

    ``log_by_candidate`` is the same log in a second copy bucketed by ``user2_id``, next
    to ``log`` and ``cohort`` bucketed by their users: then each side is summed where its
    rows lie, and the sides are joined, without a shuffle.
    """
    if short < 0 or ten_days < 0 or late[0] < 1:
        raise ValueError("windows must be 0 hours or more, and the late one start at 1 or more")
    bounds = cohort.select(
        "user_id",
        _elapsed(short + 1).alias("short_end"),
        _elapsed(ten_days + 1).alias("ten_end"),
        _elapsed(late[0]).alias("late_start"),
        _elapsed(late[1] + 1).alias("late_end"),
    )

    def seen_from(own: str, other: str, role: int, log: DataFrame = log) -> DataFrame:
        return log.join(bounds.withColumnRenamed("user_id", own), own).select(
            F.col(own).alias("user_id"),
            F.col(other).alias("other_id"),
            F.lit(role).alias("role"),
            *_USED,
            *[c for c in bounds.columns if c != "user_id"],
        )

    types = ", ".join(str(t) for t in special_types)
    plain = f"rcmd_type NOT IN ({types}) AND channel_id <> {excluded_channel}"
    flags = {
        "regi": "registered_time < short_end",
        "imp": "impression_time < short_end",
        "resp": "like_time < short_end OR dislike_time < short_end",
        "prof": f"profile_open_time < short_end AND {plain}",
        "req": "friend_request_time < short_end",
        "mat": "other_accepted_time < short_end",
        "jo": "joined_time < short_end",
        "jo10": "joined_time < ten_end",
        "prof14": f"profile_open_time >= late_start AND profile_open_time < late_end AND {plain}",
        "req14": "friend_request_time >= late_start AND friend_request_time < late_end",
        "jo14": "joined_time >= late_start AND joined_time < late_end",
    }
    mask = F.when(F.col("other_id").isNotNull(), flag_mask(flags)).otherwise(0)
    position = {name: i for i, name in enumerate(flags)}

    def side(role: int, flag: str) -> str:
        return f"sum(CASE WHEN role = {role} THEN {flag_bit('_mask', position[flag])} END)"

    sides = {
        "rcmd_regi": side(1, "regi"),
        "rcmd_imp": side(1, "imp"),
        "rcmd_resp": side(1, "resp"),
        "rcmd_req": side(1, "req"),
        "rcmd_match": side(1, "mat"),
        "rcmd_other_regi": side(2, "regi"),
        "rcmd_other_profile": side(2, "prof"),
        "rcmd_other_request": side(2, "req"),
        "rcmd_other_match": side(2, "mat"),
        "rcmd_join": f"{side(1, 'jo')} + {side(2, 'jo')}",
        "rcmd_join_10d": side(1, "jo10"),
        "rcmd_join_14d": f"{side(1, 'jo14')} + {side(2, 'jo14')}",
        "rcmd_other_profile_14d": side(2, "prof14"),
        "rcmd_other_request_14d": side(2, "req14"),
    }
    measures = [F.expr(e).alias(n) for n, e in sides.items()]
    if log_by_candidate is not None:
        return _joined_sides(
            seen_from("user1_id", "user2_id", 1), seen_from("user2_id", "user1_id", 2, log_by_candidate), mask, sides
        )
    joined = seen_from("user1_id", "user2_id", 1).unionByName(seen_from("user2_id", "user1_id", 2))
    per_pair = joined.groupBy("user_id", "role", "other_id").agg(F.bit_or(mask).alias("_mask"))
    return (
        per_pair.groupBy("user_id")
        .agg(F.min("role").alias("_first_role"), *measures)
        .filter("_first_role = 1")
        .drop("_first_role")
    )


def _joined_sides(own: DataFrame, shown: DataFrame, mask: Column, sides: dict[str, str]) -> DataFrame:
    """The sums of ``sides`` from one table for each role, joined on the user.

    A sum over one role is taken from its table; sums of both roles are added up.
    """
    tables = []
    for role, rows in ((1, own), (2, shown)):
        per_pair = rows.groupBy("user_id", "other_id").agg(F.bit_or(mask).alias("_mask"))
        parts = {
            f"{name}_{role}": part
            for name, whole in sides.items()
            for part in whole.split(" + ")
            if f"role = {role} " in part
        }
        with_role = per_pair.withColumn("role", F.lit(role))
        tables.append(with_role.groupBy("user_id").agg(*[F.expr(e).alias(n) for n, e in parts.items()]))
    both = tables[0].join(tables[1], "user_id", "left")
    return both.select(
        "user_id",
        *[
            F.expr(" + ".join(f"{name}_{role}" for role in (1, 2) if f"role = {role} " in whole)).alias(name)
            for name, whole in sides.items()
        ],
    )
