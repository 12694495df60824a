"""Flat CSV extracts: typed reads, plain writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from cohortlens.sources.schemas import EXTRACTS


def read_extract(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A headed CSV file or directory; quotes inside quoted cells are doubled.

    ``schema`` is a ``StructType``, the name of a known extract, or None to infer
    the types (one more pass over the file). NaN cells become NULL, so that
    NULL-aware operators treat them as missing. Columns are taken by header name. A
    record with other cells than the header is an error. A large file is split, which
    holds for files without line breaks in quoted cells; ``multi_line`` allows those, but
    makes each file one task. ``csv_records.read_checked`` splits such files too, and
    keeps bad records apart.
    """
    reader = spark.read.options(
        header=True,
        nanValue="NaN",
        quote='"',
        escape='"',
        multiLine=multi_line,
        mode="FAILFAST",
        columnPruning=False,
    )
    if schema is None:
        return nan_to_null(reader.option("inferSchema", True).csv(path))
    if isinstance(schema, str):
        schema = StructType.fromDDL(EXTRACTS[schema])
    raw = reader.csv(path)
    return nan_to_null(
        raw.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN as NULL in every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating}) if floating else df


def write_extract(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A headed CSV directory, one file per task; nothing passes through the driver.

    Quotes inside cells are doubled, as CSV readers expect.
    """
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)
