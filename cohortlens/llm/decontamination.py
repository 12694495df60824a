"""Benchmark decontamination: Wu-Manber search for word windows of benchmark items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD_BYTES, cut, new_folder, packed, text_bytes
from cohortlens.llm.shared_arrays import range_bucket, save_array
from cohortlens.llm.suffix_dedup import _Mapped

#: Words of a window.
WINDOW = 10
#: Words of a block of the shift table.
BLOCK = 2
#: Memory of the search tables of one part, and of a window in them besides its words.
PART_BYTES = 192 << 20
WINDOW_BYTES = 1000
#: Window hashes of one array in the shared folder.
BUCKET_WINDOWS = 4_000_000

_SPANS = "array<struct<begin:int,end:int>>"
_FOUND = f"n_words bigint, spans {_SPANS}, items array<string>"
_PAIRS = "item string, window binary, hash bigint"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Finds many word sequences of one length in a word list.

    The table of blocks (the last ``block`` words of a position) says how far the
    search may move on: past every position where no pattern can end. At a shift of
    0 the patterns with that ending block are picked by their first words, and
    compared word by word.
    """

    def __init__(self, patterns: Iterable[tuple[bytes, ...]], block: int = BLOCK) -> None:
        listed = sorted(set(patterns))
        self.length = m = len(listed[0])
        self.block = b = min(block, m)
        self.far = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for p in listed:
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.buckets.setdefault(p[m - b :], {}).setdefault(p[:b], []).append(p)

    def occurrences(self, words: Sequence[bytes]) -> Iterable[tuple[int, tuple[bytes, ...]]]:
        """(position of the first word, pattern), by rising position."""
        m, b, far, shift = self.length, self.block, self.far, self.shift
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b : end])
            move = shift.get(block, far)
            if move == 0:
                begin = end - m
                for p in self.buckets[block].get(tuple(words[begin : begin + b]), ()):
                    if tuple(words[begin:end]) == p:
                        yield begin, p
                move = 1
            end += move


def window_hashes(words: Sequence[bytes], lengths: Iterable[int]) -> Iterator[np.ndarray]:
    """Hashes of all windows of the words, for each rising length that fits."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    sums, power, done = np.zeros(len(own), np.uint64), np.uint64(1), 0
    for length in lengths:
        if length > len(own):
            return
        with np.errstate(over="ignore"):
            for j in range(done, length):
                sums[: len(own) - j] += own[j:] * power
                power *= _BASE
            x = sums[: len(own) - length + 1] + np.uint64(length)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
        done = length
        yield x ^ (x >> np.uint64(29))


class Windows:
    """Windows of benchmark items, given as (item, words joined by blanks); one search for each length."""

    def __init__(self, pairs: Iterable[tuple[str, bytes]]) -> None:
        self.owners: dict[tuple[bytes, ...], set[str]] = {}
        known: dict = {}
        for item, window in pairs:
            words = tuple(known.setdefault(w, w) for w in window.split())
            self.owners.setdefault(words, set()).add(known.setdefault(item, item))
        lengths = sorted({len(p) for p in self.owners})
        self.searches = [WuManber(p for p in self.owners if len(p) == n) for n in lengths]

    def search(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged hit spans (first word, word after the last) and the items found."""
        hits, items = [], set()
        for one in self.searches:
            for begin, p in one.occurrences(words):
                hits.append((begin, begin + one.length))
                items |= self.owners[p]
        return merged(hits), sorted(items)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def _pair_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            length = min(window, len(words))
            if not length:
                continue
            hashes = next(window_hashes(words, [length])).view(np.int64)
            for at in range(0, len(hashes), 10_000):
                own = hashes[at : at + 10_000]
                texts = [b" ".join(words[i : i + length]) for i in range(at, at + len(own))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(own)), pa.array(texts, pa.binary()), pa.array(own)],
                    ["item", "window", "hash"],
                )


def _pairs(benchmark: DataFrame, window: int) -> DataFrame:
    """The different windows of each item."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        text_bytes("text").alias("text"),
    )
    pairs = items.mapInArrow(lambda b: _pair_rows(b, window), _PAIRS)
    return cut(pairs.distinct(), "benchmark-windows")


def _met(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose window, by its hash, stands in a text of ``rows``."""
    spark = rows.sparkSession
    folder = new_folder(spark, "benchmark-hashes")
    size = F.size(F.split(F.col("window").cast("string"), " ")).alias("length")
    lengths = sorted(r[0] for r in pairs.select(size).distinct().collect())
    buckets = max(1, -(-pairs.count() // BUCKET_WINDOWS))

    @F.pandas_udf("int")
    def bucket_of(hashes: pd.Series) -> pd.Series:
        return pd.Series(range_bucket(hashes.to_numpy().view(np.uint64), buckets).astype(np.int32))

    def write(own: pd.DataFrame) -> pd.DataFrame:
        save_array(f"{folder}/windows-{own['bucket'].iloc[0]}", np.sort(own["hash"].to_numpy().view(np.uint64)))
        return own[["bucket"]][:1]

    hashes = pairs.select("hash").distinct().withColumn("bucket", bucket_of("hash"))
    done = {r["bucket"] for r in hashes.groupBy("bucket").applyInPandas(write, "bucket int").collect()}
    for b in set(range(buckets)) - done:
        save_array(f"{folder}/windows-{b}", np.zeros(0, np.uint64))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = _Mapped(folder, "windows", buckets, "u8")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for own in window_hashes(words_of(text), lengths):
                    own = np.unique(own)
                    hit = own[mapped.known(own)]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(hit.view(np.int64))], ["hash"])

    found = rows.select(text_bytes("row.text").alias("text")).mapInArrow(search, "hash bigint").distinct()
    return cut(pairs.join(found, "hash", "left_semi"), "benchmark-met")


def _weight(pairs: DataFrame) -> int:
    own = F.octet_length("window") + F.octet_length("item") + F.lit(WINDOW_BYTES).cast("bigint")
    return pairs.agg(F.sum(own)).first()[0] or 0


def _held(pairs: DataFrame):
    rows = [(r["item"], bytes(r["window"])) for r in pairs.select("item", "window").toLocalIterator()]
    return pairs.sparkSession.sparkContext.broadcast(rows)


def _searched(rows: DataFrame, benchmark: DataFrame, window: int, part_bytes: int) -> DataFrame:
    """``rows`` (one column ``row``) with ``n_words``, ``spans`` and ``items`` found in the text.

    A benchmark beyond one part is first brought down to the windows that the texts
    hold. What is left is searched part by part, and only hits are written.
    """
    pairs = _pairs(benchmark, window)
    weight = _weight(pairs)
    if weight > part_bytes:
        rows = cut(rows.withColumn("place", F.monotonically_increasing_id()), "benchmark-texts")
        pairs = _met(rows, pairs)
        weight = _weight(pairs)
    if weight <= part_bytes:
        found = rows.select("row", _search_udf(_held(pairs))(text_bytes("row.text")).alias("found"))
        return found.select("row", "found.*")
    parts, paths = -(-weight // part_bytes), []
    for part in range(parts):
        held = _held(pairs.filter(F.pmod(F.xxhash64("item", "window"), F.lit(parts)) == part))
        paths.append(new_folder(rows.sparkSession, "benchmark-hits"))
        texts = rows.select("place", text_bytes("row.text").alias("text"))
        texts.mapInPandas(_hit_rows(held), f"place bigint, spans {_SPANS}, items array<string>").write.parquet(paths[-1])
        held.destroy()
    hits = rows.sparkSession.read.schema(f"place bigint, spans {_SPANS}, items array<string>").parquet(*paths)
    hits = hits.groupBy("place").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )

    @F.pandas_udf("bigint")
    def n_words(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    return rows.join(hits, "place", "left").select(
        "row",
        n_words(text_bytes("row.text")).alias("n_words"),
        _merge_parts(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _hit_rows(held):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = Windows(held.value)
        for own in batches:
            rows = []
            for place, text in zip(own["place"], own["text"], strict=True):
                spans, items = windows.search(words_of(text))
                if spans:
                    rows.append((place, [{"begin": a, "end": b} for a, b in spans], items))
            yield pd.DataFrame(rows, columns=["place", "spans", "items"])

    return found


def _search_udf(held):
    @F.pandas_udf(_FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = Windows(held.value)
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                spans, items = windows.search(words)
                rows.append((len(words), [{"begin": a, "end": b} for a, b in spans], items))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return found


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (words, end excluded), ``n_hit``, ``items``.

    A window is ``window`` consecutive words of an item, or all words of a shorter
    one. Windows go to the workers as search tables of bounded size. A benchmark that
    fits one part is searched in the texts where they lie; a larger one see ``_searched``.
    NULL and empty texts have no words. A NULL item id counts as an empty one; items
    of equal ids are one item. Columns with the names of the results are replaced.
    """
    rows = packed(docs.drop("n_words", "hit_spans", "n_hit", "items"))
    return _searched(rows, benchmark, window, part_bytes).select(
        "row.*",
        "n_words",
        F.col("spans").alias("hit_spans"),
        F.aggregate(
            "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"]
        ).alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"),
    )


def _merge_parts(spans: Column) -> Column:
    @F.pandas_udf(_SPANS)
    def merge(found: pd.Series) -> pd.Series:
        rows = [merged((s["begin"], s["end"]) for s in one) for one in found]
        return pd.Series([[{"begin": a, "end": b} for a, b in row] for row in rows], dtype=object)

    return merge(spans)


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, number and checksum of the items found."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, columns unchanged."""
    return _searched(packed(docs), benchmark, WINDOW, PART_BYTES).filter(F.size("spans") == 0).select("row.*")
