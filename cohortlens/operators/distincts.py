"""Many conditional distinct counts at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FLAGS = 63


def flag_mask(flags: Mapping[str, str]) -> Column:
    """One bigint with a bit per flag; a condition that is not true leaves its bit 0."""
    if len(flags) > MAX_FLAGS:
        raise ValueError(f"at most {MAX_FLAGS} flags fit one mask, got {len(flags)}")
    bits = [f"CASE WHEN {p} THEN {1 << i}L ELSE 0L END" for i, p in enumerate(flags.values())]
    return F.expr(" | ".join(bits))


def flag_bit(mask: str, position: int) -> str:
    """SQL for the 0/1 value of one flag in a mask column."""
    return f"shiftright({mask}, {position}) & 1"


def flag_masks(flags: Mapping[str, str]) -> list[Column]:
    """As many masks as the flags need, ``MAX_FLAGS`` in each."""
    named = list(flags.items())
    return [
        flag_mask(dict(named[i : i + MAX_FLAGS])) for i in range(0, len(named), MAX_FLAGS)
    ]


def distinct_by_flags(
    rows: DataFrame,
    keys: Sequence[str],
    counted: str,
    flags: Mapping[str, str],
) -> DataFrame:
    """``count(distinct case when flag then counted end)`` per flag and group.

    ``flags`` maps output names to SQL conditions. Each counted value is first
    reduced to one mask of all its flags, then the bits are summed: two plain hash
    aggregates, both combined before their shuffle, that move one number per counted
    value however many flags there are (the direct form multiplies the rows by the
    flag count). The first shuffle is on (keys, counted), so a hot group is spread
    by its counted values. The NULL test is in the mask: a group that has only NULL
    values stays, with zeros.
    """
    known = F.col(counted).isNotNull()
    per_value = rows.groupBy(*keys, counted).agg(
        *[
            F.bit_or(F.when(known, mask).otherwise(0)).alias(f"_mask{i}")
            for i, mask in enumerate(flag_masks(flags))
        ]
    )
    bits = [flag_bit(f"_mask{i // MAX_FLAGS}", i % MAX_FLAGS) for i in range(len(flags))]
    return per_value.groupBy(*keys).agg(
        *[F.expr(f"sum({bit})").alias(n) for bit, n in zip(bits, flags, strict=True)]
    )
