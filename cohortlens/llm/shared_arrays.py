"""Counts that tasks send by bucket, and arrays in the shared folder that tasks memory-map."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs

#: Entries that a counter holds before it hands them out.
HELD = 3_000_000

BUCKET_ROWS = "kind string, bucket int, data binary"


def local_path(uri: str) -> str | None:
    """Path of a ``file:`` URI or plain path; None for other stores."""
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save_array(uri: str, values: np.ndarray) -> None:
    """Write ``values`` under ``uri``. The file appears whole or not at all, so a task
    that runs twice, or two at once, leave the same file."""
    path, data = local_path(uri), np.ascontiguousarray(values)
    part = f".{uuid.uuid4().hex}.part"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        data.tofile(path + part)
        os.replace(path + part, path)
        return
    store, where = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(where + part) as out:
        out.write(data.tobytes())
    store.move(where + part, where)


def map_array(uri: str, dtype: str) -> np.ndarray:
    """The array under ``uri``, memory-mapped; from another store it is fetched once a node."""
    path = local_path(uri)
    if path is None:
        store, where = fs.FileSystem.from_uri(uri)
        path = os.path.join(tempfile.gettempdir(), "cohortlens", *where.split("/")[-2:])
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_input_file(where) as source, open(part, "wb") as out:
                while block := source.read(1 << 24):
                    out.write(block)
            os.replace(part, path)
    if os.path.getsize(path) == 0:
        return np.zeros(0, dtype)
    return np.memmap(path, dtype, "r")


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences, and further columns, byte plane by byte plane, compressed."""
    squeeze = zstandard.ZstdCompressor(level=1)
    out = []
    for values in (np.diff(keys, prepend=keys.dtype.type(0)), *columns):
        planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
        out.append((values.dtype.str, len(values), squeeze.compress(planes.tobytes())))
    return pickle.dumps(out)


def unpack(data: bytes) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    out = []
    for dtype, n, planes in pickle.loads(data):
        raw = np.frombuffer(expand.decompress(planes), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(-1, n).T).view(dtype).reshape(n) if n else np.zeros(0, dtype))
    return [np.cumsum(out[0], dtype=out[0].dtype), *out[1:]]


def summed(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, and the sum of each column by key."""
    if not len(keys):
        return [keys, *columns]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[begin], *[np.add.reduceat(c[order], begin) for c in columns]]


def range_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by hash range: rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_row(kind: str, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind]), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())],
        ["kind", "bucket", "data"],
    )


def merged_rows(rows: pd.DataFrame) -> list[np.ndarray]:
    """Distinct keys and sums of the packed rows of a bucket."""
    parts = [unpack(d) for d in rows["data"]]
    return summed(*[np.concatenate(c) for c in zip(*parts, strict=True)])


class BucketCounter:
    """Adds up keys, and hands them out by bucket when it holds many."""

    def __init__(self, kind: str, bucket_of: Callable, buckets: int) -> None:
        self.kind, self.bucket_of, self.buckets = kind, bucket_of, buckets
        self.held: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append([keys, *columns])
        self.size += len(keys)
        if self.size >= HELD:
            self._merge()
            if self.size >= HELD // 2:
                yield from self.flush()

    def _merge(self) -> None:
        self.held = [summed(*[np.concatenate(c) for c in zip(*self.held, strict=True)])]
        self.size = len(self.held[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        self._merge()
        keys, *columns = self.held[0]
        self.held, self.size = [], 0
        bucket = self.bucket_of(keys, self.buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        for b, (begin, end) in enumerate(zip([0, *ends], ends, strict=False)):
            if end > begin:
                own = order[begin:end]
                yield bucket_row(self.kind, b, pack(keys[own], *[c[own] for c in columns]))
