"""Warehouse tables: catalog tables or partitioned Parquet directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.sources.schemas import TABLES


def read_table(
    spark: SparkSession,
    name: str,
    root: str | None = None,
    catalog_name: str | None = None,
) -> DataFrame:
    """One of the known tables.

    With ``root`` the table is the Parquet directory ``root/name``, read with its
    declared schema (no footer sampling, partition columns stay strings);
    otherwise it is ``catalog_name`` (default ``name``) in the session catalog.
    """
    if root is None:
        return spark.table(catalog_name or name)
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")

