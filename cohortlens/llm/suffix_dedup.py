"""Suffix-array dedup: long byte strings that start at two places are cut out of texts.

Every window of ``length`` bytes has an anchor: the place of its smallest hashed
piece. Windows in a row with one anchor make a segment; equal windows have equal
anchors, so they lie in segments with one anchor hash. Segments whose anchor hash
occurs once hold no repeat. The others, equal ones at most twice, are dealt to shards
by anchor hash, and each shard is sorted: a suffix that shares ``length`` bytes with its
neighbour starts a repeat.

An anchor hash with more text than a shard is dealt further. Equal windows have their
anchor at one offset, so the windows of a range of offsets can only be equal where the
bytes are that all of them hold: the piece and what stands next to it. Segments go by the
hash of those bytes, for halves of the range, until a group fits a shard. A range of one
offset is the window itself, and needs no sorting.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortlens.llm.common import cut, new_folder, packed, text_bytes
from cohortlens.llm.induced_sort import repeated_starts
from cohortlens.llm.shared_arrays import (
    BUCKET_ROWS,
    BucketCounter,
    map_array,
    merged_rows,
    range_bucket,
    save_array,
)

#: Bytes of a repeat, and of the hashed pieces.
LENGTH = 400
PIECE = 128
#: Windows taken in one go, at about 90 bytes of memory each; a longer text is taken in parts.
PART = 255 << 10
#: Bytes of text for each bucket of anchor hashes, and of segments (with second copies)
#: for each shard. Sorting takes about 50 bytes of memory a byte.
BUCKET_BYTES = 128 << 20
SHARD_BYTES = 3 << 20

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_REP = np.dtype(
    [("doc", "u8"), ("hash", "i8"), ("pos", "i8"), ("len", "i8"), ("cid", "i8"), ("n", "i8"), ("shard", "i8")]
)
_SPANS = "array<struct<begin:bigint,end:bigint>>"


class Anchors:
    """Segments of texts: runs of windows with one anchor."""

    def __init__(self, length: int = LENGTH, piece: int = PIECE) -> None:
        self.length, self.piece = length, min(piece, length)
        self.up, self.down = self._powers(_BASE, 1 << 12), self._powers(pow(_BASE, -1, 1 << 64), 1 << 12)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of each piece of the text."""
        while len(self.up) < len(data):
            n = 4 * len(self.up)
            self.up, self.down = self._powers(_BASE, n), self._powers(pow(_BASE, -1, 1 << 64), n)
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        x = (sums[self.piece :] - sums[: -self.piece]) * self.down[: len(data) - self.piece + 1]
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def segments(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, anchor hash): segments cover all windows, each window in one."""
        found = [self._part(text, at) for at in range(0, max(len(text) - self.length + 1, 0), PART)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _part(self, text: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(text, np.uint8)[at : at + PART + self.length - 1]
        hashes = self._hashes(data)
        pieces = self.length - self.piece + 1
        # The place stands in the low bits: the smallest value is the first of the smallest.
        marked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        fill = np.full(-len(marked) % pieces, np.uint64(2**64 - 1))
        rows = np.concatenate([marked, fill]).reshape(-1, pieces)
        to_end = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        from_begin = np.minimum.accumulate(rows, axis=1).ravel()
        n = len(hashes) - pieces + 1
        anchor = (np.minimum(to_end[:n], from_begin[pieces - 1 : pieces - 1 + n]) & _PLACE).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        end = np.append(begin[1:], n) - 1 + self.length
        return begin + at, end + at, hashes[anchor[begin]]

    def place(self, segment: bytes) -> int:
        """Place of the anchor in a segment: its smallest piece, as that is in all windows."""
        return int(np.argmin(self._hashes(np.frombuffer(segment, np.uint8)) & ~_PLACE))


def _key_rows(batches: Iterator[pa.RecordBatch], buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    anchors, counter = Anchors(length), BucketCounter("anchor", range_bucket, buckets)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            keys = anchors.segments(text)[2]
            yield from counter.add(keys, np.ones(len(keys), np.int64))
    yield from counter.flush()


def _repeated_keys(texts: DataFrame, folder: str, buckets: int, length: int) -> None:
    """Write the anchor hashes that occur twice, by hash range."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        keys, counts = merged_rows(rows)
        save_array(f"{folder}/anchors-{bucket}", keys[counts > 1])
        return pd.DataFrame({"bucket": [bucket]})

    rows = texts.mapInArrow(lambda b: _key_rows(b, buckets, length), BUCKET_ROWS)
    done = {r["bucket"] for r in rows.groupBy("bucket").applyInPandas(write, "bucket int").collect()}
    for bucket in set(range(buckets)) - done:
        save_array(f"{folder}/anchors-{bucket}", np.zeros(0, np.uint64))


class _Mapped:
    """Sorted arrays of a folder, by range bucket of their first field, opened when needed."""

    def __init__(self, folder: str, name: str, buckets: int, dtype) -> None:
        self.where, self.buckets, self.dtype, self.open = f"{folder}/{name}", buckets, dtype, {}

    def part(self, bucket: int) -> np.ndarray:
        if bucket not in self.open:
            self.open[bucket] = map_array(f"{self.where}-{bucket}", self.dtype)
        return self.open[bucket]

    def known(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        bucket = range_bucket(keys, self.buckets)
        for b in np.unique(bucket):
            own, part = np.flatnonzero(bucket == b), self.part(int(b))
            if len(part):
                out[own] = part[np.minimum(np.searchsorted(part, keys[own]), len(part) - 1)] == keys[own]
        return out


def _segment_rows(
    batches: Iterator[pa.RecordBatch], folder: str, buckets: int, length: int
) -> Iterator[pa.RecordBatch]:
    anchors, repeated = Anchors(length), _Mapped(folder, "anchors", buckets, "u8")
    for batch in batches:
        texts = batch.column(2).to_pylist()
        found = [anchors.segments(t) for t in texts]
        begin, end, key = (np.concatenate(c) for c in zip(*found, strict=True))
        row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        live = np.flatnonzero(repeated.known(key))
        begin, end, key, row = begin[live], end[live], key[live], row[live]
        body = np.fromiter(
            (xxhash.xxh64_intdigest(texts[r][a:b]) for r, a, b in zip(row, begin, end, strict=True)),
            np.uint64,
            len(row),
        )
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at)]
            + [pa.array(c.astype(np.int64, copy=False)) for c in (begin, end - begin, key.view(np.int64), body.view(np.int64))],
            ["id", "hash", "pos", "len", "key", "body"],
        )


class Cores:
    """Groups of segments by the bytes that all windows of a range of anchor offsets hold."""

    def __init__(self, length: int, piece: int = PIECE) -> None:
        self.length, self.piece = length, min(piece, length)
        self.pieces = self.length - self.piece + 1
        self.levels = (self.pieces - 1).bit_length() + 1

    def groups(self, text: bytes, place: int, large: list[set[bytes]]) -> Iterator[tuple[int, int, bytes, bool]]:
        """(level, first offset, group, whether it is large) of a segment with its anchor at ``place``.

        ``large`` has the large groups of each level done: those give way to their halves.
        """
        first, last = place - (len(text) - self.length), place
        begins, size = [0], 1 << (self.levels - 1)
        for level in range(min(len(large) + 1, self.levels)):
            halves = []
            for begin in begins:
                end = min(begin + size, self.pieces) - 1
                if end < first or begin > last:
                    continue
                core = text[place - begin : place + self.length - end]
                group = xxhash.xxh3_128_digest(core, seed=size << 32 | begin)
                known = level < len(large) and group in large[level]
                if known and size > 1:
                    halves += [begin, begin + size // 2]
                else:
                    yield level, begin, group, known
            begins, size = halves, size // 2


def _placed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    anchors = Anchors(length)
    for batch in batches:
        places = [anchors.place(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["cid", "n", "text", "place"])


def _level_rows(batches: Iterator[pa.RecordBatch], large: list[set[bytes]], length: int) -> Iterator[pa.RecordBatch]:
    """The groups of the next level, with the bytes of each segment."""
    cores = Cores(length)
    for batch in batches:
        found, sizes = [], []
        for text, place in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            own = [g for level, _, g, _ in cores.groups(text, place, large) if level == len(large)]
            found += own
            sizes += [len(text)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(sizes, pa.int64())], ["core", "len"])


def _last_rows(batches: Iterator[pa.RecordBatch], large: list[set[bytes]], length: int) -> Iterator[pa.RecordBatch]:
    """The group of each range of a segment, or the bytes known to be covered by repeats."""
    cores = Cores(length)
    for batch in batches:
        rows = []
        for cid, n, text, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = [(0, len(text))] if n > 1 else []
            for _, offset, group, known in cores.groups(text, place, large):
                if known:
                    spans.append((place - offset, place - offset + length))
                else:
                    rows.append((cid, len(text), group, None, None))
            merged = _merged_spans({"begin": a, "end": b} for a, b in spans)
            rows += [(cid, len(text), None, a, b) for a, b in merged]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["cid", "len", "core", "begin", "end"]
        )


def _dealt_by_core(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Texts of the segments of large anchor hashes by shard, and spans that need no sorting.

    Large groups are fewer than the bytes of a level over those of a shard, so the
    driver holds them. A group of one content holds no repeat but the content's own.
    """
    texts = cut(texts.mapInArrow(lambda b: _placed(b, length), "cid bigint, n bigint, text binary, place bigint"), "suffix-placed")
    large: list[set[bytes]] = []
    while len(large) < Cores(length).levels:
        rows = texts.mapInArrow(lambda b, done=list(large): _level_rows(b, done, length), "core binary, len bigint")
        most = rows.groupBy("core").agg(F.sum("len").alias("len"), F.count("*").alias("n"))
        found = {bytes(r["core"]) for r in most.filter((F.col("len") > SHARD_BYTES) & (F.col("n") > 1)).toLocalIterator()}
        if not found:
            break
        large.append(found)
    last = cut(
        texts.mapInArrow(
            lambda b: _last_rows(b, large, length), "cid bigint, len bigint, core binary, begin bigint, end bigint"
        ),
        "suffix-cores",
    )
    groups = last.filter("core IS NOT NULL")
    several = groups.groupBy("core").agg(F.count("*").alias("members")).filter("members > 1").select("core")
    groups = cut(groups.join(several, "core", "left_semi").select("core", "cid", "len"), "suffix-groups")
    shards = max(1, -(-(groups.agg(F.sum("len")).first()[0] or 0) // SHARD_BYTES))
    members = groups.select(F.pmod(F.xxhash64("core"), F.lit(shards)).cast("int").alias("shard"), "cid").distinct()
    return (
        members.join(texts, "cid").select("shard", "cid", F.lit(1).cast("bigint").alias("n"), "text"),
        last.filter("core IS NULL").select("cid", "begin", "end"),
    )


def _shards(
    rows: DataFrame, contents: DataFrame, folder: str, buckets: int, length: int
) -> tuple[DataFrame, DataFrame | None]:
    """Texts of the contents by shard, none much over ``SHARD_BYTES``, and spans known without sorting."""
    held = F.sum(F.col("len") * F.least("n", F.lit(2)))
    total = contents.agg(held).first()[0] or 0
    large = cut(contents.groupBy("key").agg(held.alias("held")).filter(F.col("held") > SHARD_BYTES).select("key"), "suffix-large")
    any_large = not large.isEmpty()

    def texts_of(own: DataFrame, where: str, shards: int) -> DataFrame:
        _write_representatives(own, where, buckets, shards)
        return rows.select(F.xxhash64("id", "hash").alias("doc"), "hash", "text").mapInArrow(
            lambda b: _content_rows(b, where, buckets), "shard int, cid bigint, n bigint, text binary"
        )

    small = contents.join(F.broadcast(large), "key", "left_anti") if any_large else contents
    texts = texts_of(small, folder, max(1, -(-total // SHARD_BYTES)))
    if not any_large:
        return texts, None
    own = texts_of(contents.join(F.broadcast(large), "key", "left_semi"), f"{folder}-large", 1).drop("shard")
    by_core, spans = _dealt_by_core(own, length)
    # Shards of both kinds are numbered apart.
    return texts.unionByName(by_core.withColumn("shard", -1 - F.col("shard"))), spans


def _write_representatives(contents: DataFrame, folder: str, buckets: int, shards: int) -> None:
    """Write, by hash range of the document, where to cut one copy of each content."""
    own = contents.select(
        F.xxhash64("at.id", "at.hash").alias("doc"),
        F.col("at.hash").alias("hash"),
        F.col("at.pos").alias("pos"),
        "len",
        "cid",
        "n",
        F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"),
    )
    bucket = F.floor((F.shiftrightunsigned("doc", 32) * buckets) / F.lit(float(1 << 32))).cast("int")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(rows), _REP)
        for name in _REP.names:
            values = rows[name].to_numpy()
            out[name] = values.view(np.uint64) if name == "doc" else values
        save_array(f"{folder}/texts-{rows['bucket'].iloc[0]}", out[np.argsort(out["doc"], kind="stable")])
        return pd.DataFrame({"bucket": rows["bucket"][:1]})

    done = own.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(write, "bucket int").collect()
    for b in set(range(buckets)) - {r["bucket"] for r in done}:
        save_array(f"{folder}/texts-{b}", np.zeros(0, _REP))


def _content_rows(batches: Iterator[pa.RecordBatch], folder: str, buckets: int) -> Iterator[pa.RecordBatch]:
    mapped = _Mapped(folder, "texts", buckets, _REP)
    for batch in batches:
        docs = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        hashes = batch.column(1).to_numpy(zero_copy_only=False)
        shards, cids, counts, texts = [], [], [], []
        for i, b in enumerate(range_bucket(docs, buckets)):
            part = mapped.part(int(b))
            begin, end = np.searchsorted(part["doc"], docs[i]), np.searchsorted(part["doc"], docs[i], "right")
            if begin < end:
                text = batch.column(2)[i].as_py()
                for r in part[begin:end]:
                    if r["hash"] == hashes[i]:
                        shards.append(int(r["shard"]))
                        cids.append(int(r["cid"]))
                        counts.append(int(r["n"]))
                        texts.append(text[r["pos"] : r["pos"] + r["len"]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(shards, pa.int32()), pa.array(cids, pa.int64()), pa.array(counts, pa.int64()), pa.array(texts, pa.binary())],
            ["shard", "cid", "n", "text"],
        )


def _shard_spans(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """(cid, begin, end): bytes of each content that repeats cover, from the shard's suffix order.

    A content that occurs more than once stands in the shard twice, so that its
    repeats too show as common prefixes.
    """
    rows = rows.sort_values("cid").drop_duplicates("cid")
    texts, twice = list(rows["text"]), rows["text"][rows["n"] > 1]
    found = repeated_starts([*texts, *twice], length)
    cids, begins, ends = [], [], []
    for cid, starts in zip(rows["cid"], found, strict=False):
        if len(starts):
            gap = np.flatnonzero(np.diff(starts) > 1)
            first = starts[np.concatenate([[0], gap + 1])]
            last = starts[np.append(gap, len(starts) - 1)]
            cids += [cid] * len(first)
            begins += first.tolist()
            ends += (last + length).tolist()
    return pd.DataFrame({"cid": cids, "begin": begins, "end": ends}, dtype=np.int64)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, hash, spans): bytes to remove of each document with repeats, unmerged.

    A document is known by its id and the hash of its text; rows equal in both count
    as so many documents, and have the same spans.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "suffix-dedup")
    rows = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), text_bytes("text").alias("text")
    ).filter(F.octet_length("text") >= length)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    _repeated_keys(rows.select("text"), folder, buckets, length)
    schema = StructType(
        [rows.schema["id"], rows.schema["hash"]]
        + [StructField(n, LongType()) for n in ("pos", "len", "key", "body")]
    )
    live = cut(rows.mapInArrow(lambda b: _segment_rows(b, folder, buckets, length), schema), "suffix-segments")
    contents = cut(
        live.groupBy("key", "body", "len")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "hash", "pos")).alias("at"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "suffix-contents",
    )
    texts, known = _shards(rows, contents, folder, buckets, length)
    spans = texts.groupBy("shard").applyInPandas(
        lambda rows: _shard_spans(rows, length), "cid bigint, begin bigint, end bigint"
    )
    if known is not None:
        spans = spans.unionByName(known)
    by_content = spans.groupBy("cid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    cuts = cut(contents.select("cid", "key", "body", "len").join(by_content, "cid").drop("cid"), "suffix-cuts")
    moved = F.transform(
        "spans", lambda s: F.struct((F.col("pos") + s["begin"]).alias("begin"), (F.col("pos") + s["end"]).alias("end"))
    )
    return (
        live.join(cuts, ["key", "body", "len"])
        .groupBy("id", "hash")
        .agg(F.flatten(F.collect_list(moved)).alias("spans"))
    )


def _merged_spans(spans: Iterable) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``kept`` (bytes), ``n_bytes``, ``removed`` spans, ``n_removed``, ``n_spans``.

    Texts are their UTF-8 bytes. Each byte goes that is covered by a string of
    ``length`` bytes which also starts at another place, of the same text or another
    one; overlaps count, nothing matches across texts, and all is judged on the
    input. ``kept`` is the rest joined, and may split a character. A NULL text has no
    bytes; shorter texts than ``length`` stay whole. Columns with the names of the
    results are replaced.
    """

    @F.pandas_udf(f"kept binary, n_bytes bigint, removed {_SPANS}, n_removed bigint, n_spans bigint")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, spans, strict=True):
            merged = _merged_spans(own) if own is not None else []
            borders = [0, *[x for s in merged for x in s], len(text)]
            kept = b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
            cuts = [{"begin": a, "end": b} for a, b in merged]
            rows.append((kept, len(text), cuts, len(text) - len(kept), len(merged)))
        return pd.DataFrame(rows, columns=["kept", "n_bytes", "removed", "n_removed", "n_spans"])

    results = ("kept", "n_bytes", "removed", "n_removed", "n_spans")
    found = repeated_spans(docs, length)
    joined = packed(docs.drop(*results)).join(
        found,
        F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("hash")),
        "left",
    )
    return joined.withColumn("cut", cut_out(text_bytes("row.text"), F.col("spans"))).select("row.*", "cut.*")


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the checksum of what is left."""
    return dedup_substrings(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
