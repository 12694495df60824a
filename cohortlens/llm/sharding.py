"""Sharding by rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import free_name

#: Slots of a shard are numbered in so many pieces.
PIECES = 256


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key: the one with the smallest ``-ln(u) / weight``.

    ``u`` is a uniform number made from the hash of (key, shard). A shard's number
    depends on the key and the shard alone, so a further shard only takes keys that
    it wins, and a shard gets keys in proportion to its weight. NULL is a key like
    any other. A weight of 0 or less gets nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a weight above 0")
    bids = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
            u = (bits.cast("double") + 0.5) * 2.0**-53
            bids.append(F.struct((-F.ln(u) / float(weight)).alias("bid"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*bids))["shard"] if len(bids) > 1 else bids[0]["shard"]


def assign_shards(
    rows: DataFrame, key: str, weights: Sequence[float], name: str = "shard"
) -> DataFrame:
    """``rows`` with the shard of each row's key; no shuffle.

    A column of that name is replaced. Rows of equal keys share a shard.
    """
    return rows.withColumn(name, rendezvous(F.col(key), weights))


def number_slots(
    rows: DataFrame, shard: str, order: Sequence[Column], pieces: int = PIECES, name: str = "slot"
) -> DataFrame:
    """``rows`` with a gapless number from 0 within each shard.

    A shard is cut into ``pieces`` by the hash of the ordering columns; each piece is
    numbered on its own and starts after the rows of the pieces before it. So no
    shard is sorted in one task, and the table of piece sizes has at most
    shards x ``pieces`` rows, whatever the input. Rows equal in all ordering columns
    get their numbers in any order.
    """
    piece, size, start = (free_name(rows, n) for n in ("_piece", "_size", "_start"))
    dealt = rows.withColumn(piece, F.pmod(F.xxhash64(*order), F.lit(pieces)).cast("int"))
    before = Window.partitionBy(shard).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(shard, piece)
        .agg(F.count("*").alias(size))
        .withColumn(start, F.coalesce(F.sum(size).over(before), F.lit(0)))
        .drop(size)
    )
    own = Window.partitionBy(shard, piece).orderBy(*order)
    return (
        dealt.withColumn(name, F.row_number().over(own).cast("bigint") - 1)
        .join(F.broadcast(starts), [shard, piece])
        .withColumn(name, F.col(name) + F.col(start))
        .select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() != name], name)
    )


def shard_documents(
    docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None
) -> DataFrame:
    """``docs`` with ``shard`` and a gapless ``slot`` in it, keyed by ``doc_id``.

    Columns named ``shard`` or ``slot`` are replaced. An empty table stays empty;
    empty, NULL and very long texts are rows like others.
    """
    placed = assign_shards(docs, "doc_id", list(weights or [1.0] * shards))
    return number_slots(placed, "shard", [F.col("doc_id"), F.crc32(F.col("text").cast("binary"))])


def sharding_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Per document: size, text checksum, shard, slot, and the shard with one more shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign_shards(slim, "doc_id", [1.0] * shards)
    grown = assign_shards(placed, "doc_id", [1.0] * (shards + 1), "grown_shard")
    slotted = number_slots(grown, "shard", [F.col("doc_id"), F.col("text_crc32")])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
