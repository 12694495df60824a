"""SimHash near-dedup: Golay-code keys of fingerprint segments, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, packed, text_bytes
from cohortlens.llm.components import components

#: Words of a shingle, seed of its hash, most differing bits of a link.
SHINGLE = 3
SEED = 42
BITS = 3
#: Fixed value: generator polynomial of the binary Golay code of 23 bits, 12 of them data.
GENERATOR = 0b101011100011
#: Bits of the segments of a fingerprint, and the distance within which a codeword gives a key.
WIDTHS = (13, 13, 13, 13, 12)
REACH = 4
#: Of a key: two segments taken as they are, and the one after them taken by codewords.
CHOICES = [
    (i, j, next(k % len(WIDTHS) for k in range(j + 1, j + 4) if k % len(WIDTHS) != i))
    for i, j in combinations(range(len(WIDTHS)), 2)
]
#: Fingerprints and groups with more than this share of all rows are joined apart.
HOT_SHARE = 1000
#: Fingerprints of one key are compared in pieces of at most about so many.
PIECE = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: each is 1 if set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), dtype=">u8", count=n
    )
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint of the whole text as a (signed) bigint.

    NULL, empty and blank texts have fingerprint 0; a text of fewer words than a
    shingle is one shingle.
    """

    @F.pandas_udf("bigint")
    def of_texts(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return docs.withColumn(name, of_texts(text_bytes("text")))


def near_codewords(width: int = WIDTHS[0], reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(start, number): the Golay codewords within ``reach`` bits of each segment value.

    A segment of ``width`` bits stands in the low bits of a word of 23. The code is
    perfect: every word has one codeword within 3 bits, so that codeword lies within
    4 bits of every word one bit away. Two segments that differ in at most one bit
    thus share a codeword number.
    """
    data = np.arange(4096, dtype=np.uint32)
    codewords = np.zeros(4096, np.uint32)
    for bit in range(12):
        codewords ^= np.where(data >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0))
    values = np.arange(1 << width, dtype=np.uint32)
    near, sizes = [], []
    for part in np.array_split(values, max(1, len(values) >> 10)):
        close = np.bitwise_count(part[:, None] ^ codewords[None, :]) <= reach
        near.append(np.nonzero(close)[1].astype(np.int64))
        sizes.append(close.sum(axis=1))
    return np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(near)


def _key_batches(batches: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
    starts, numbers = tables.value
    wide = WIDTHS[0]
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        segments, low = [], 0
        for width in WIDTHS:
            own = prints.view(np.uint64) >> np.uint64(low) & np.uint64((1 << width) - 1)
            segments.append(own.astype(np.int64))
            low += width
        for choice, (i, j, k) in enumerate(CHOICES):
            exact = ((choice << wide | segments[i]) << wide | segments[j]) << 12
            count = starts[segments[k] + 1] - starts[segments[k]]
            row = np.repeat(np.arange(len(prints)), count)
            within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            keys = exact[row] | numbers[starts[segments[k]][row] + within]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[row])], ["key", "print"])


def candidate_keys(prints: DataFrame) -> DataFrame:
    """(key, print): several keys for each distinct fingerprint.

    A key is the bits of two of five segments and a codeword number near a third, 38
    bits and the choice of segments. At most three errors leave two segments or more
    without any. If just two are, each other one has one error, so the third segment
    of that pair will do. Otherwise one segment at most has more than one error, and
    of the pairs among three error-free ones not all go with that segment.
    """
    tables = prints.sparkSession.sparkContext.broadcast(near_codewords())
    return prints.select("print").mapInArrow(
        lambda batches: _key_batches(batches, tables), "key bigint, print bigint"
    )


def _reach(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(print, smallest print reachable within this set) of those that have a link."""
    rest = np.unique(prints)
    vertices, roots = [], []
    while len(rest):
        root, wave, rest = rest[0], rest[:1], rest[1:]
        while len(wave) and len(rest):
            near = np.zeros(len(rest), bool)
            for some in np.array_split(wave, -(-len(wave) // 64)):
                far = np.bitwise_count(some[:, None].view(np.uint64) ^ rest[None, :].view(np.uint64))
                near |= (far <= bits).any(axis=0)
            wave, rest = rest[near], rest[~near]
            vertices.append(wave)
            roots.append(np.full(len(wave), root))
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (vertices, roots))


def _link_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints of a key, from rows sorted by key."""
    held_k, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64)
    batches = iter(batches)
    while True:
        batch = next(batches, None)
        if batch is not None:
            held_k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            held_p = np.concatenate([held_p, batch.column(1).to_numpy(zero_copy_only=False)])
            done = int(np.searchsorted(held_k, held_k[-1])) if len(held_k) else 0
        else:
            done = len(held_k)
        k, p, held_k, held_p = held_k[:done], held_p[:done], held_k[done:], held_p[done:]
        a, b = _links(k, p, bits)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if batch is None:
            return


def _links(k: np.ndarray, p: np.ndarray, bits: int, few: int = 32) -> tuple[np.ndarray, np.ndarray]:
    begin = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1]) if len(k) else np.zeros(0, int)
    size = np.diff(np.concatenate([begin, [len(k)]]))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at, n in zip(begin[size > few], size[size > few], strict=True):
        found.append(tuple(_reach(p[at : at + n], bits)))
    small = np.repeat(size <= few, size)
    k, p = k[small], p[small]
    for step in range(1, few):
        same = k[step:] == k[:-step]
        if not same.any():
            break
        x, y = p[step:][same], p[:-step][same]
        near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= bits
        found.append((x[near], y[near]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def fingerprint_links(prints: DataFrame, bits: int = BITS, piece: int = PIECE) -> DataFrame:
    """(a, b) links that connect what the links within ``bits`` connect.

    ``prints`` has the distinct fingerprints. The fingerprints of a key are compared
    bit by bit; of a larger set only a spanning set of links goes on. A key with more
    than ``piece`` fingerprints is cut into pieces by hash, and each pair of pieces is
    compared on its own.
    """
    if bits > 3:
        raise ValueError("the keys hold for at most 3 differing bits")
    keys = candidate_keys(prints)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > piece)
    # A table of its own, so that the join may split a key with many fingerprints.
    cuts = cut(sizes.select("key", F.ceil(F.col("n") / piece).cast("int").alias("g")), "simhash-sizes")
    keys = keys.join(cuts, "key", "left").select("key", "print", F.coalesce("g", F.lit(1)).alias("g"))
    own = F.pmod(F.xxhash64("print"), F.col("g")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    placed = (
        keys.select("key", "print", "g", own.alias("s"), other.alias("t"))
        .select(
            F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t")).alias("key"), "print"
        )
    )
    dealt = placed.repartition("key").sortWithinPartitions("key", "print")
    return dealt.mapInArrow(lambda b: _link_batches(b, bits), "a bigint, b bigint").distinct()


def _joined_by(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to a table with one row of each ``key``; both are written tables.

    Keys with more than a thousandth of all rows, of which there are fewer than a
    thousand, are broadcast with their values, so their rows stay where they are.
    """
    least = rows.count() // HOT_SHARE
    found = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(key)
    hot = cut(values.join(F.broadcast(cut(found, "simhash-hot")), key, "left_semi"), "simhash-hot-values")
    apart = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values, key)
    return apart.unionByName(others)


def _classes(prints: DataFrame) -> DataFrame:
    """(print, root) of each distinct fingerprint."""
    distinct = cut(prints.select("print").distinct(), "simhash-prints")
    roots = components(fingerprint_links(distinct))
    return distinct.join(roots, distinct["print"] == roots["vertex"], "left").select(
        "print", F.coalesce("root", "print").alias("root")
    )


def near_duplicate_classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, print, root) of each row: rows of one root are one group."""
    slim = fingerprints(docs.select("doc_id", "text"), "print", shingle).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "print"
    )
    slim = cut(slim, "simhash-rows")
    return _joined_by(slim, cut(_classes(slim), "simhash-roots"), "print")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """Per document: fingerprint as 16 hex digits and the smallest doc_id of its group."""
    rows = cut(near_duplicate_classes(docs), "simhash-classes")
    ids = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-ids")
    return _joined_by(rows, ids, "root").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def dedup_simhash(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, columns unchanged: the smallest doc_id.

    Fingerprints link at 3 or fewer differing bits; groups are what links connect, so
    all texts without words are one group. Rows without doc_id come last; of rows
    with one doc_id the smaller text hash stays, and equal rows leave one.
    """
    rows = cut(near_duplicate_classes(docs), "simhash-classes")
    order = Window.partitionBy("root").orderBy(F.asc_nulls_last("doc_id"), "text_hash")
    kept = rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1")
    repeated = (
        rows.groupBy("doc_id", "text_hash").agg((F.count("*") > 1).alias("_more"))
    )
    kept = kept.alias("k").join(
        repeated.alias("r"),
        F.col("k.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("k.text_hash") == F.col("r.text_hash")),
    )
    found = cut(
        kept.select(
            F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"), "_more"
        ),
        "simhash-kept",
    )
    met = packed(docs).join(
        found,
        F.col("row.doc_id").eqNullSafe(F.col("kept_id"))
        & (F.xxhash64("row.text") == F.col("kept_hash")),
    )
    first = Window.partitionBy("kept_id", "kept_hash").orderBy(F.xxhash64("row"))
    again = met.filter("_more").withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    return met.filter("NOT _more").select("row.*").unionByName(again.select("row.*"))
