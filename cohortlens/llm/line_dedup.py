"""Line dedup: overlapping windows of consecutive lines that occurred before are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, packed

#: Lines of a window.
WIDTH = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(id, text hash, position, two hashes) of each window of ``width`` lines."""
    lines = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_th"),
        F.split("text", "\n").alias("_lines"),
    ).filter(F.size("_lines") >= width)
    at = F.transform(
        F.sequence(F.lit(1), F.size("_lines") - (width - 1)),
        lambda i: _window_hash(i, width),
    )
    return lines.select("_id", "_th", F.posexplode(at).alias("_pos", "_h")).select(
        "_id", "_th", "_pos", F.col("_h.a").alias("_a"), F.col("_h.b").alias("_b")
    )


def _window_hash(i: Column, width: int) -> Column:
    own = [F.element_at("_lines", (i + k).cast("int")) for k in range(width)]
    return F.struct(F.xxhash64(*own).alias("a"), F.hash(*own).alias("b"))


def repeated_starts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, text hash, sorted positions) of windows whose lines occurred earlier.

    Windows are compared by 96 bits of hash. Earlier means a smaller (id, text hash,
    position), NULL ids first. Each window is first counted, combined before the
    shuffle; only windows that occur twice are joined back, and a window that a third
    of all documents share is split by the skew handling of that join.
    """
    found = _windows(docs, width)
    first = cut(
        found.groupBy("_a", "_b")
        .agg(F.count("*").alias("_n"), F.min(F.struct("_id", "_th", "_pos")).alias("_first"))
        .filter("_n > 1")
        .select("_a", "_b", "_first"),
        "repeated-windows",
    )
    later = found.join(first, ["_a", "_b"]).filter(
        ~F.struct("_id", "_th", "_pos").eqNullSafe(F.col("_first"))
    )
    return later.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("_pos")).alias("_starts"))


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines``, ``n_removed``, ``n_spans``.

    A line goes if any window that covers it is a later occurrence; touching windows
    merge into one span. Texts of fewer than ``width`` lines have no window and stay
    whole; an empty text is one empty line; a NULL text has no lines and stays NULL.
    Rows equal in doc_id and text count as one document and come out alike. Columns
    with the names of the results are replaced.
    """
    results = ["kept_text", "n_lines", "n_removed", "n_spans"]
    starts = repeated_starts(docs.select("doc_id", "text"), width)
    joined = packed(docs.drop(*results)).join(
        starts,
        F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_th")),
        "left",
    )
    hit = F.col("_starts").isNotNull()
    cuts = joined.withColumns(
        {
            "lines": F.coalesce(F.split("row.text", "\n"), F.array().cast("array<string>")),
            "begins": F.expr(f"filter(_starts, (x, i) -> i = 0 OR x - _starts[i - 1] > {width})"),
            "ends": F.expr(
                "transform(filter(_starts, (x, i) -> i = size(_starts) - 1"
                f" OR _starts[i + 1] - x > {width}), x -> x + {width})"
            ),
        }
    )
    between = F.expr(
        "flatten(transform(sequence(0, size(ends)), i -> slice(lines,"
        " CASE WHEN i = 0 THEN 1 ELSE ends[i - 1] + 1 END,"
        " CASE WHEN i = size(ends) THEN size(lines) ELSE begins[i] END"
        " - CASE WHEN i = 0 THEN 0 ELSE ends[i - 1] END)))"
    )
    kept = cuts.withColumn("kept", F.when(hit, between).otherwise(F.col("lines")))
    return kept.select(
        "row.*",
        F.when(hit, F.concat_ws("\n", "kept")).otherwise(F.col("row.text")).alias("kept_text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_removed"),
        F.when(hit, F.size("begins")).otherwise(0).cast("bigint").alias("n_spans"),
    )


def line_dedup_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: lines, removed lines, spans and the SHA-256 of the kept text."""
    kept = F.coalesce(F.col("kept_text"), F.lit("")).cast("binary")
    return dedup_lines(docs.select("doc_id", "text"), width).select(
        "doc_id", "n_lines", "n_removed", "n_spans", F.sha2(kept, 256).alias("kept_sha256")
    )
