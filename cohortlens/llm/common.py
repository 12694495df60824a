"""Helpers that several operators use: scratch tables, free column names, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table that an operator broadcasts.
BROADCAST_ROWS = 100_000

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; others become spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; without it a new one, if all runs on one machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cohortlens-")
        sc.setCheckpointDir(folder)
    return f"{folder}/cohortlens"


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again, which ends its lineage."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables that no later step reads."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most ``rows`` rows, and so may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(column: Column | str) -> Column:
    """UTF-8 bytes of a text, none for NULL."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def id_text(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(rows: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that added columns cannot clash with them."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
