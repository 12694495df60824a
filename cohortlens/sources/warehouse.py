"""Stored layouts: tables partitioned by day or bucketed by user, kept in the session catalog.

A layout is written once and found again by name, as long as the files that it was
made from have not changed.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; tables joined on the user need the same number.
BUCKETS = 32
DAY = "date_ymd_kst"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without it a new one, if all runs on one machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cohortlens-")
        sc.setCheckpointDir(folder)
    return f"{folder}/cohortlens"


def file_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the names, sizes and times of all files under ``paths``."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(conf).listFiles(where, True)
        while files.hasNext():
            one = files.next()
            found.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()[:16]


def by_day(df: DataFrame, path: str, table: str, day: str = DAY) -> None:
    """``df`` as a table with one directory for each day.

    Rows are rebalanced by day before the write, which splits a large day over several
    tasks and files and keeps small days in one file each.
    """
    df.hint("rebalance", F.col(day)).write.option("path", path).partitionBy(day).saveAsTable(table)


def by_bucket(df: DataFrame, path: str, table: str, user: str, buckets: int = BUCKETS) -> None:
    """``df`` as a table with a file of each bucket of ``user``, sorted by it.

    Joins and aggregates on the user need no shuffle between tables of one number of
    buckets. All rows of a user are in one bucket and so in one task: choose ``buckets``
    for the size of a bucket, and leave tables plain where a few users have a great
    share of the rows.
    """
    placed = df.repartition(buckets, user)
    placed.write.option("path", path).bucketBy(buckets, user).sortBy(user).saveAsTable(table)


def stored(
    spark: SparkSession,
    name: str,
    inputs: Sequence[str],
    build: Callable[[], DataFrame],
    write: Callable[[DataFrame, str, str], None],
) -> DataFrame:
    """The table ``name`` made by ``build`` from the files under ``inputs``.

    It is written by ``write`` (table, path, catalog name) where the catalog of the
    session has none of these inputs yet. The folder of a write that fails is never
    named in the catalog, so the next call writes a new one.
    """
    table = f"cohortlens_{name}_{file_state(spark, inputs)}"
    if not spark.catalog.tableExists(table):
        write(build(), f"{shared_root(spark)}/{table}-{uuid.uuid4().hex}", table)
    return spark.table(table)
