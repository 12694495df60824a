"""Rows labelled by their position relative to the user's first purchase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The use type that was renamed, and its new name.
RENAMED_USE_TYPE = ("타임어택", "친구 신청")


def first_purchases(log: DataFrame, keys: Sequence[str], every: bool = False) -> DataFrame:
    """(``keys``, ``first_action``): the action number of each user's first purchase.

    ``every`` keeps all rows marked as first purchase, so a user marked twice
    multiplies in a later join; by default the earliest mark counts.
    """
    marked = log.filter(F.col("purchase_num") == 1).dropna(subset=list(keys))
    if every:
        return marked.select(*keys, F.col("action_num").alias("first_action"))
    return marked.groupBy(*keys).agg(F.min("action_num").alias("first_action"))


def label_periods(
    log: DataFrame,
    group: str,
    user: str,
    steps: tuple[int, int] = (10, 20),
    every: bool = False,
) -> DataFrame:
    """Usage rows (quantity <= 0) with ``period`` and a positive ``quantity``.

    ``pre`` before the first purchase, ``post_10``/``post_20`` (named by ``steps``)
    for the actions after it, ``non`` for users who never purchased. The purchase
    itself, later actions and rows without a user have no period and are left out.
    """
    near, far = steps
    keys = [group, user]
    known = log.dropna(subset=keys)
    first = first_purchases(known, keys, every).withColumn("_payer", F.lit(True))
    joined = known.filter(F.col("quantity") <= 0).join(first, keys, "left")
    action, start = F.col("action_num"), F.col("first_action")
    period = (
        F.when(F.col("_payer").isNull(), "non")
        .when(action < start, "pre")
        .when((action > start) & (action <= start + near), f"post_{near}")
        .when((action > start + near) & (action <= start + far), f"post_{far}")
    )
    labelled = (
        joined.withColumn("period", period)
        .filter(F.col("period").isNotNull())
        .withColumn("quantity", F.abs("quantity"))
        .drop("first_action", "_payer")
    )
    return clean_use_type(labelled)


def clean_use_type(df: DataFrame) -> DataFrame:
    """Rename the old use type (plain text replacement) and name missing ones ``Other``."""
    if "use_type" not in df.columns:
        return df
    old, new = (F.lit(t) for t in RENAMED_USE_TYPE)
    return df.withColumn(
        "use_type", F.coalesce(F.replace(F.col("use_type"), old, new), F.lit("Other"))
    )
