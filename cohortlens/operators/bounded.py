"""Broadcast sides whose size is tested when the query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held(df: DataFrame, rows: int, advice: str = "") -> DataFrame:
    """``df`` for a broadcast; the query fails if it has more than ``rows`` rows.

    The limit comes before the count, so neither the task that counts nor the
    broadcast ever holds more than ``rows`` + 1 rows.
    """
    size = F.count("*").over(Window.partitionBy())
    message = f"more than {rows} rows to broadcast" + (f"; {advice}" if advice else "")
    return F.broadcast(
        df.limit(rows + 1)
        .withColumn("_size", size)
        .filter(F.when(F.col("_size") <= rows, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
        .drop("_size")
    )
