"""CSV files read by many tasks, also where quoted cells hold line breaks, with bad records kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlens.sources.extracts import nan_to_null
from cohortlens.sources.schemas import EXTRACTS

_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": "_bad"}


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"')))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(``file``, ``block``, ``line``, ``record``): the records of CSV files, header records included.

    The files are split like any text. A line break is the end of a record if an even
    number of quotes stands before it in the file. So each block counts its quotes,
    the few block totals tell whether a block begins inside a quoted cell, and running
    counts within the blocks do the rest. Only records of several lines are put
    together by a shuffle on the record; they may reach over any number of blocks.
    ``block`` and ``line`` order the records of a file. Files must be UTF-8 text with quotes
    doubled inside quoted cells; a carriage return before a line break is dropped, also
    inside a cell.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.regexp_replace("value", "\r$", "").alias("value"),
    )
    odd = F.pmod(_quotes(F.col("value")), F.lit(2)).cast("int")
    lines = lines.withColumn("_odd", odd)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("_odd").alias("_sum")).select(
        "file", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")
    )
    so_far = Window.partitionBy("file", "block").orderBy("line")
    upto = F.col("_before") + F.sum("_odd").over(so_far)
    placed = (
        lines.join(blocks, ["file", "block"])
        .withColumn("_open_after", F.pmod(upto, F.lit(2)) == 1)
        .withColumn("_inside", F.pmod(upto - F.col("_odd"), F.lit(2)) == 1)
    )
    whole = placed.filter("NOT _inside AND NOT _open_after").select("file", "block", "line", F.col("value").alias("record"))
    # Lines of records that go on: numbered by how many such records have begun in the file.
    broken = placed.filter("_inside OR _open_after")
    begins = F.when(~F.col("_inside"), 1).otherwise(0)
    begun = broken.groupBy("file", "block").agg(F.sum(begins).alias("_sum")).select(
        "file", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_records")
    )
    numbered = broken.join(begun, ["file", "block"]).withColumn("_record", F.col("_records") + F.sum(begins).over(so_far))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = (
        numbered.groupBy("file", "_record")
        .agg(parts.alias("_parts"))
        .select(
            "file",
            F.col("_parts")[0]["block"].alias("block"),
            F.col("_parts")[0]["line"].alias("line"),
            F.array_join("_parts.value", "\n").alias("record"),
        )
    )
    return whole.unionByName(joined)


def read_checked(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad records) of headed CSV files.

    ``schema`` is a ``StructType`` or the name of a known extract; its columns are taken by
    header name, and further columns of the files are ignored. All files must have the
    header of the first. Bad records come as (``file``, ``record``, ``reason``): with other
    cells than the header, with a quote that never ends, or with a cell that is not of
    its type; count them before using the good rows. Empty lines are no records. NaN
    cells become NULL.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(EXTRACTS[schema])
    records = csv_records(spark, path).filter("record <> ''")
    first = records.groupBy("file").agg(F.min(F.struct("block", "line", "record")).alias("_head"))
    head = first.orderBy("file").select("_head.record").first()
    names = [] if head is None else _cells_of(spark, head["record"])
    missing = [f.name for f in schema.fields if f.name not in names]
    if head is not None and missing:
        raise ValueError(f"no column {', '.join(missing)} in the header {head['record']!r}")
    text = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))] + [StructField("_bad", StringType())])
    body = records.filter(F.col("record") != F.lit(head["record"] if head else ""))
    parsed = body.withColumn("_row", F.from_csv("record", text.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), _OPTIONS))
    open_ = F.pmod(_quotes(F.col("record")), F.lit(2)) == 1
    casts, wrong = {}, []
    for f in schema.fields:
        i = names.index(f.name) if f.name in names else 0
        cell = F.col(f"_row.c{i}") if names else F.lit(None).cast("string")
        casts[f.name] = cell.try_cast(f.dataType)
        wrong.append(F.when(cell.isNotNull() & casts[f.name].isNull(), F.lit(f.name)))
    types = F.array_compact(F.array(*wrong))
    reason = (
        F.when(open_, "a quote never ends")
        .when(F.col("_row._bad").isNotNull(), "other cells than the header")
        .when(F.size(types) > 0, F.concat(F.lit("not of its type: "), F.array_join(types, ", ")))
    )
    judged = parsed.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").select(*[c.alias(n) for n, c in casts.items()])
    return nan_to_null(good), judged.filter("reason IS NOT NULL").select("file", "record", "reason")


def _cells_of(spark: SparkSession, line: str) -> list[str]:
    """The cells of one CSV record."""
    width = line.count(",") + 1
    fields = ", ".join(f"c{i} string" for i in range(width))
    row = spark.range(1).select(F.from_csv(F.lit(line), fields, {"quote": '"', "escape": '"'}).alias("r")).first()["r"]
    return [c for c in row if c is not None]
