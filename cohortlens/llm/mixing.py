"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, is_small, packed

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times the source's size.
MOST = 3
#: A hash of BITS x LEVELS bits; each level splits the boundary bucket into 2^BITS.
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    """Number of runs without blanks; 0 for NULL."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    parts = F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.when(trimmed == "", 0).otherwise(parts).cast("bigint")


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits that depend on the id and the text."""
    what = F.concat(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
        F.lit("|"),
        F.coalesce(F.col(text), F.lit("")),
    )
    return F.conv(F.substring(F.md5(what.cast("binary")), 1, 15), 16, 10).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight, none above ``most`` times its size.

    Sources that reach their limit give the excess to the others by weight. That ends
    at one level L with target = min(limit, weight x L): with the sources in order of
    limit / weight, the ones at their limit come first, so running sums give the level
    at which each source would be the first below its limit. The highest of those
    that hold is L. One row per source; the windows run over this table only.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumns(
        {
            "_w": F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]),
                (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"),
            ),
            "_limit": F.col("source_size").cast("double") * most,
        }
    ).withColumn("_ratio", F.col("_limit") / F.col("_w"))
    every = Window.partitionBy()
    so_far = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    below = so_far.rowsBetween(Window.unboundedPreceding, -1)
    from_here = so_far.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        listed.withColumns(
            {
                "_total": F.sum("source_size").over(every).cast("double"),
                "_full": F.coalesce(F.sum("_limit").over(below), F.lit(0.0)),
                "_rest_w": F.sum("_w").over(from_here),
            }
        )
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_rest_w"))
        .withColumn(
            "_found", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every)
        )
        .withColumn("target", F.least(F.col("_limit"), F.col("_w") * F.col("_found")))
        .select("source", "source_size", "target")
    )


def thresholds(
    slim: DataFrame,
    targets: DataFrame,
    bits: int = BITS,
    levels: int = LEVELS,
    few_sources: bool = False,
) -> DataFrame:
    """Targets with ``whole`` copies of the source and the hash ``bound`` below which a
    document gets one more.

    ``slim`` is (source, hash, size). Sizes are summed by source and hash bucket; the
    bucket in which the running sum passes the budget is split again, up to the full
    hash. Each level after the first reads only rows of boundary buckets; no row is
    sorted, only at most 2^bits sums for each source. ``few_sources`` says that there
    are few enough to broadcast their state.
    """
    parted = targets.withColumn(
        "_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("int"),
    )
    state = parted.filter(F.col("source_size") > 0).select(
        F.col("source").alias("_s"),
        F.lit(0).cast("bigint").alias("_prefix"),
        (F.col("target") - F.col("_whole") * F.col("source_size")).alias("_rest"),
    )
    for level in range(1, levels + 1):
        shift = bits * (levels - level)
        hist = (
            slim.join(
                F.broadcast(state) if few_sources else state,
                F.col("source").eqNullSafe(F.col("_s"))
                & (F.shiftright(F.col("hash"), shift + bits) == F.col("_prefix")),
            )
            .groupBy("_s", "_rest", F.shiftright(F.col("hash"), shift).alias("_prefix"))
            .agg(F.sum("size").alias("_sum"))
        )
        upto = Window.partitionBy("_s").orderBy("_prefix")
        state = (
            hist.withColumn("_end", F.sum("_sum").over(upto))
            .withColumn("_start", F.col("_end") - F.col("_sum"))
            .filter((F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_end")))
            .select("_s", "_prefix", (F.col("_rest") - F.col("_start")).alias("_rest"))
        )
    bound = state.select("_s", F.col("_prefix").alias("_bound"))
    return parted.join(bound, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", "source_size", "target", "_whole", F.coalesce("_bound", F.lit(0)).alias("_bound")
    )


def _mixed(docs: DataFrame, weights: Sequence[int], most: int) -> tuple[DataFrame, DataFrame]:
    """Slim rows (doc_id, source, hash, size), written once, and the bounds by source."""
    slim = cut(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            document_hash().alias("hash"),
            word_count(F.col("text")).alias("size"),
        ),
        "mix-rows",
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, most), "mix-targets")
    few = is_small(targets)
    bounds = cut(thresholds(slim, targets, few_sources=few), "mix-bounds")
    return slim, F.broadcast(bounds) if few else bounds


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, columns unchanged.

    Words of each source come to its target, less the part of one document. A source
    below its target is repeated whole, up to ``most`` times. Documents without words
    follow their hash like others and cost nothing; NULL is a source. Rows equal in
    doc_id and text share one fate. An empty table stays empty.
    """
    _, bounds = _mixed(docs, weights, most)
    marked = packed(docs).withColumns(
        {"hash": document_hash("row.doc_id", "row.text"), "of": F.col("row.source").cast("string")}
    )
    copies = F.col("_whole") + F.when(F.col("hash") < F.col("_bound"), 1).otherwise(0)
    return (
        marked.join(bounds, F.col("of").eqNullSafe(F.col("source")))
        .withColumn("take", copies)
        .filter("take > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("take"))))
        .select("row.*")
    )


def mixing_digest(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """Per document: size, its source's size and target, and the words taken."""
    slim, bounds = _mixed(docs, weights, most)
    found = bounds.withColumnRenamed("source", "_of")
    copies = F.col("_whole") + F.when(F.col("hash") < F.col("_bound"), 1).otherwise(0)
    return slim.join(found, F.col("source").eqNullSafe(F.col("_of"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken")
    )
