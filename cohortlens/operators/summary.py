"""Per-column summaries, one output row per summarised column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.firsts import first_per_key
from cohortlens.operators.quantiles import exact_quantiles


def _long(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast(as_type).alias("value"))
        for c in columns
    ]
    return df.select(F.inline(F.array(*cells)))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum.

    NaN counts as missing. All but the quartiles come from one aggregate over the
    wide rows; only the quartiles need a row for each cell.
    """
    numbers = df.select(
        *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]
    )
    long = _long(numbers, columns, "double")
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = numbers.agg(
        *[f(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in measures.items()]
    )
    plain = wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        *[F.col(f"{name}_{i}").alias(name) for name in measures],
                    )
                    for i, c in enumerate(columns)
                ]
            )
        )
    )
    quartiles = exact_quantiles(long, ["column_name"], "value", (0.25, 0.5, 0.75))
    return plain.join(quartiles.drop("n"), "column_name", "left").select(
        "column_name",
        "count",
        "mean",
        "std",
        "min",
        F.col("q_0").alias("p25"),
        F.col("q_1").alias("p50"),
        F.col("q_2").alias("p75"),
        "max",
    )


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, number of distinct values, and the most frequent value with its frequency.

    The smallest value wins a tie.
    """
    freq = (
        _long(df, columns, "string").groupBy("column_name", "value").agg(F.count("*").alias("freq"))
    )
    totals = freq.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("freq"))), F.lit(0)).alias("count"),
        F.count("value").alias("unique"),
    )
    top = first_per_key(
        freq.filter(F.col("value").isNotNull()),
        ["column_name"],
        [F.desc("freq"), F.asc("value")],
    ).select("column_name", F.col("value").alias("top"), "freq")
    return totals.join(top, "column_name", "left").select(
        "column_name", "count", "unique", "top", "freq"
    )


def describe_all(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """Numeric and text summaries in one table; what does not apply is NULL."""
    both = describe_text(df, text).unionByName(
        describe_numeric(df, numeric), allowMissingColumns=True
    )
    return both.select(
        "column_name", "count", "unique", "top", "freq",
        "mean", "std", "min", "p25", "p50", "p75", "max",
    )
