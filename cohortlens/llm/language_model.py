"""Language-model scoring: an interpolated modified Kneser-Ney model of any order from 2.

Counted in Spark, stored as sorted hash arrays in the shared folder, and memory-mapped
by the workers that score texts.

Words are 64-bit hashes; a word's number is its place among the sorted hashes of all
training words, 64 bits wide. A gram is a row of numbers, stored under a 64-bit hash of
them. Tasks count what they read, and send (bucket, compressed arrays) rows; a bucket's
task adds them up, writes its part of the arrays, and sends on what its grams say of
their contexts and of the grams without the first word. Words are bucketed by hash
range and grams by their hash, so a frequent word weighs no more than a rare one in any
task. From the highest order down each order is one job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import id_text, new_folder, packed, text_bytes
from cohortlens.llm.shared_arrays import (
    BUCKET_ROWS,
    BucketCounter,
    bucket_row,
    map_array,
    merged_rows,
    pack,
    range_bucket,
    save_array,
    unpack,
)

#: Bytes of text for each bucket of counts, and of text taken in one go.
BUCKET_BYTES = 32 << 20
CHUNK_BYTES = 4 << 20
#: Words of the longest gram.
ORDER = 2
#: A line break is in no word, so this hash stands for the end of a text.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))

def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, mod 7, is 2."""
    return F.pmod(F.crc32(id_text(doc_id).cast("binary")), F.lit(7)) == 2


def _chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= CHUNK_BYTES:
            yield own
            own, size = [], 0
    if own:
        yield own


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and the number of tokens of each text; every text has an end."""
    words: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.lower().split()
        words += own
        words.append(b"\n")
        sizes[i] = len(own) + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), sizes


@dataclass
class Words:
    """Sorted word hashes with counts, in parts by hash range."""

    folder: str
    buckets: int
    sizes: np.ndarray
    total: int

    def __post_init__(self) -> None:
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.parts: dict[str, np.ndarray] = {}

    @property
    def distinct(self) -> int:
        return int(self.starts[-1])

    def part(self, what: str, bucket: int, dtype: str, suffix: str = "") -> np.ndarray:
        name = f"{what}-{bucket}{suffix}"
        if name not in self.parts:
            self.parts[name] = map_array(f"{self.folder}/{name}", dtype)
        return self.parts[name]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each hash; -1 and 0 for unknown ones. ``hashes`` is sorted."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bucket = range_bucket(hashes, self.buckets)
        for b in np.unique(bucket):
            if not self.sizes[b]:
                continue
            begin, end = np.searchsorted(bucket, [b, b + 1])
            known = self.part("words", int(b), "u8")
            at = np.minimum(np.searchsorted(known, hashes[begin:end]), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashes[begin:end])
            number[begin + hit] = at[hit] + self.starts[b]
            count[begin + hit] = self.part("counts", int(b), "i8")[at[hit]]
        return number, count


def _word_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counter = BucketCounter("word", range_bucket, buckets)
    for batch in batches:
        for texts in _chunks(batch.column(0).to_pylist()):
            keys, counts = np.unique(_tokens(texts)[0], return_counts=True)
            yield from counter.add(keys, counts.astype(np.int64))
    yield from counter.flush()


def count_words(texts: DataFrame, folder: str, buckets: int) -> Words:
    """Counts of all training tokens, written by hash range. ``texts`` has one binary column."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["bucket"].iloc[0])
        keys, counts = merged_rows(rows)
        save_array(f"{folder}/words-{bucket}", keys)
        save_array(f"{folder}/counts-{bucket}", counts)
        return pd.DataFrame({"bucket": [bucket], "n": [len(keys)], "total": [counts.sum()]})

    rows = texts.mapInArrow(lambda b: _word_rows(b, buckets), BUCKET_ROWS)
    found = rows.groupBy("bucket").applyInPandas(write, "bucket int, n bigint, total bigint").collect()
    sizes = np.zeros(buckets, np.int64)
    for r in found:
        sizes[r["bucket"]] = r["n"]
    return Words(folder, buckets, sizes, sum(r["total"] for r in found))


def _grams(texts: list[bytes], words: Words, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(numbers, count of the word, tokens of each text) over all tokens.

    The numbers are ``order`` arrays, the last one of the tokens and those before it of
    the words in front of them. Before a text stands the number after the last word's.
    """
    hashes, sizes = _tokens(texts)
    keys, where = np.unique(hashes, return_inverse=True)
    number, count = words.find(keys)
    place = np.arange(len(hashes)) + (order - 1) * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(hashes) + (order - 1) * len(sizes), words.distinct, np.int64)
    padded[place] = number[where]
    return [padded[place - back] for back in range(order - 1, -1, -1)], count[where], sizes


def _hashed(numbers: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of numbers: each number is mixed into the hash of those before."""
    out = np.full(len(numbers[0]), len(numbers), np.uint64)
    for column in numbers:
        out = (out ^ (column.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(27)
    return out


class GramCounter(BucketCounter):
    """Adds up counts of grams; sends their numbers and counts, by the first number."""

    def _merge(self) -> None:
        keys, counts, *numbers = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held = [_counted(keys, counts, numbers)]
        self.size = len(self.held[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        if len(self.held) > 1:
            self._merge()
        keys, counts, *numbers = self.held[0]
        self.held, self.size = [], 0
        bucket = self.bucket_of(keys, self.buckets)
        order = np.argsort(bucket * (int(numbers[0].max()) + 1) + numbers[0])
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        for b, (begin, end) in enumerate(zip([0, *ends], ends, strict=False)):
            if end > begin:
                own = order[begin:end]
                columns = [_narrow(c[own]) for c in (numbers[0], counts, *numbers[1:])]
                yield bucket_row(self.kind, b, pack(*columns))


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if values.max() <= np.iinfo(np.uint32).max else values


def _counted(keys: np.ndarray, counts: np.ndarray | None, numbers: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct keys in order, the sum of counts (one each without any), and the numbers of each."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.diff(np.append(begin, len(keys))) if counts is None else np.add.reduceat(counts[order], begin)
    return [keys[begin], sums, *[c[order[begin]] for c in numbers]]


def _context_sums(keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Distinct contexts in order; of each the sum of counts, and how many are 1, 2 and more."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ones, twos = (np.add.reduceat((counts == k).astype(np.int64), begin) for k in (1, 2))
    size = np.diff(np.append(begin, len(keys)))
    return [keys[begin], np.add.reduceat(counts, begin), ones, twos, size - ones - twos]


def _gram_rows(batches: Iterator[pa.RecordBatch], words: Words, order: int) -> Iterator[pa.RecordBatch]:
    counter = GramCounter("gram", range_bucket, words.buckets)
    for batch in batches:
        for texts in _chunks(batch.column(0).to_pylist()):
            numbers, _, _ = _grams(texts, words, order)
            yield from counter.add(*_counted(_hashed(numbers), None, numbers))
    yield from counter.flush()


def _count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def _place_bucket(words: Words):
    """Bucket of a word number: the one of its hash."""
    ends = words.starts[1:]
    return lambda numbers, buckets: np.minimum(
        np.searchsorted(ends, numbers.astype(np.int64), side="right"), buckets - 1
    )


#: Counts from this one on are kept apart.
LARGE = 255


def _save_counts(uri: str, counts: np.ndarray) -> None:
    """A byte for each count, and the places and values of large ones in an array of their own."""
    counts = counts.reshape(-1)
    large = np.flatnonzero(counts >= LARGE)
    save_array(uri, np.minimum(counts, LARGE).astype(np.uint8))
    save_array(f"{uri}-large", np.concatenate([large, counts[large]]).astype(np.int64))


def _gram_part(rows: pd.DataFrame, words: Words, order: int, level: int) -> Iterator[pa.RecordBatch]:
    """Write one part of the grams of ``level`` words, and of what longer ones say of them as
    contexts; send on what it says of the shorter ones.

    Of the highest order the counts are those of the texts, of others the number of
    words that stand before.
    """
    bucket = int(rows["bucket"].iloc[0])
    if level < order:
        _write_contexts(rows, words, bucket, level + 1)
    parts = [unpack(d) for d in rows.loc[rows["kind"] == "gram", "data"]]
    if not parts:
        parts = [[np.zeros(0, np.int64)] * (level + 1)]
    first, counts, *others = [np.concatenate(c) for c in zip(*parts, strict=True)]
    del parts
    numbers = [c.astype(np.int64) for c in (first, *others)]
    keys, counts = _hashed(numbers), counts.astype(np.int64)
    if len(keys):
        keys, counts, *numbers = _counted(keys, counts, numbers)
    save_array(f"{words.folder}/grams{level}-{bucket}", keys)
    _save_counts(f"{words.folder}/gram_counts{level}-{bucket}", counts)
    for kind, data in rows.loc[rows["kind"].str.startswith("seen"), ["kind", "data"]].itertuples(index=False):
        yield bucket_row(kind, bucket, data)
    yield bucket_row(f"seen{level}", bucket, _count_of_counts(counts).astype(np.int64).tobytes())
    if not len(keys):
        return
    contexts = _context_sums(_hashed(numbers[:-1]), counts)
    yield from _sent(BucketCounter("context", range_bucket, words.buckets), *contexts)
    del contexts
    if level > 2:
        shorter = _counted(_hashed(numbers[1:]), None, numbers[1:])
        yield from _sent(GramCounter("gram", range_bucket, words.buckets), *shorter)
    else:
        left = _counted(numbers[1].astype(np.uint64), None, [])
        yield from _sent(BucketCounter("left", _place_bucket(words), words.buckets), *left)


def _sent(counter: BucketCounter, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from counter.add(keys, *columns)
    yield from counter.flush()


def _write_contexts(rows: pd.DataFrame, words: Words, bucket: int, level: int) -> None:
    """Hashes of the contexts of ``level``; of each the sum of counts, and how many are 1, 2 and more.

    A context of two or more words that was met once is left out: as every gram but
    the last of a text is a context, it is one of the stored grams of its length. Only
    the context in front of a text is no gram.
    """
    own = rows[rows["kind"] == "context"]
    keys, *sums = merged_rows(own) if len(own) else [np.zeros(0, t) for t in "Qqqqq"]
    if level > 2:
        kept = (sums[0] != 1) | (keys == _hashed([np.array([words.distinct])] * (level - 1)))
        keys, sums = keys[kept], [c[kept] for c in sums]
    save_array(f"{words.folder}/contexts{level}-{bucket}", keys)
    _save_counts(f"{words.folder}/context_sums{level}-{bucket}", np.stack(sums, axis=1))


def _word_part(rows: pd.DataFrame, words: Words) -> pd.DataFrame:
    """Write the continuation counts of a range of words, and the contexts of one word.

    Returned are sums for the whole model: counts of counts, and of words.
    """
    bucket = int(rows["bucket"].iloc[0])
    _write_contexts(rows, words, bucket, 2)
    left = np.zeros(int(words.sizes[bucket]), np.int64)
    own = rows[rows["kind"] == "left"]
    if len(own):
        keys, n = merged_rows(own)
        left[keys.astype(np.int64) - int(words.starts[bucket])] = n
    save_array(f"{words.folder}/left-{bucket}", left)
    counts = np.bincount(np.minimum(left, 5), minlength=6)
    found = [("left", np.concatenate([counts[1:5], [(left >= 3).sum(), left.sum()]]))]
    for kind in sorted(k for k in set(rows["kind"]) if k.startswith("seen")):
        found.append((kind, sum(np.frombuffer(d, np.int64) for d in rows.loc[rows["kind"] == kind, "data"])))
    return pd.DataFrame({"kind": [k for k, _ in found], "sums": [list(map(int, v)) for _, v in found]})


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from counts of counts.

    An estimate that is not above 0, as of a few texts, gives way to half the count, so
    that every context leaves something to words not seen after it.
    """
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
        own = k - (k + 1) * y * b / a if a else k * y
        d.append(own if own > 0 else k / 2)
    return np.array(d)


@dataclass
class KneserNey:
    """A stored model: its words, the discounts of each order from 2, and the continuation sums."""

    words: Words
    gram_discounts: dict[int, np.ndarray]
    word_discounts: np.ndarray
    left_total: int
    left_kinds: np.ndarray

    def of_words(self, v: np.ndarray) -> np.ndarray:
        """Probability of a word by its continuations, mixed with the uniform one."""
        uniform = 1.0 / (self.words.distinct + 1)
        if not self.left_total:
            return np.full(len(v), uniform)
        left = self._left(v)
        d = self.word_discounts
        spare = (d[1:] * self.left_kinds).sum() / self.left_total
        return np.maximum(left - d[np.minimum(left, 3)], 0) / self.left_total + spare * uniform

    def _left(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        known = np.flatnonzero(numbers >= 0)
        bucket = _place_bucket(self.words)(numbers[known], self.words.buckets)
        for b in np.unique(bucket):
            own = known[bucket == b]
            out[own] = self.words.part("left", int(b), "i8")[numbers[own] - self.words.starts[b]]
        return out

    def _stored(self, what: str, sums: str, keys: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of counts of sorted hashes; zeros for unknown ones."""
        out = np.zeros((len(keys), width), np.int64)
        bucket = range_bucket(keys, self.words.buckets)
        for b in np.unique(bucket):
            begin, end = np.searchsorted(bucket, [b, b + 1])
            known = self.words.part(what, int(b), "u8")
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[begin:end]), len(known) - 1)
            hit = np.flatnonzero(known[at] == keys[begin:end])
            counts = self.words.part(sums, int(b), "u1").reshape(-1, width)[at[hit]].astype(np.int64)
            row, column = np.nonzero(counts == LARGE)
            if len(row):
                places, values = self.words.part(sums, int(b), "i8", "-large").reshape(2, -1)
                counts[row, column] = values[np.searchsorted(places, at[hit][row] * width + column)]
            out[begin + hit] = counts
        return out

    def _of_grams(self, numbers: list[np.ndarray], shorter: np.ndarray) -> np.ndarray:
        """Probability of the last words after those before, mixed with that of one word less."""
        level = len(numbers)
        d = self.gram_discounts[level]
        contexts = _hashed(numbers[:-1])
        order = np.argsort(contexts)
        contexts = contexts[order]
        begin = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
        size, contexts = np.diff(np.append(begin, len(contexts))), contexts[begin]
        sums = self._stored(f"contexts{level}", f"context_sums{level}", contexts, 4)
        if level > 2:
            fresh = np.flatnonzero(sums[:, 0] == 0)
            once = self._stored(f"grams{level - 1}", f"gram_counts{level - 1}", contexts[fresh])[:, 0] > 0
            sums[fresh[once], :2] = 1
        safe, spare = np.empty(len(order)), np.empty(len(order))
        total = np.maximum(sums[:, 0], 1).astype(float)
        safe[order] = np.repeat(total, size)
        spare[order] = np.repeat(np.where(sums[:, 0] > 0, sums[:, 1:] @ d[1:] / total, 1.0), size)
        keys = _hashed(numbers)
        order = np.argsort(keys)
        counts = np.empty(len(keys), np.int64)
        counts[order] = self._stored(f"grams{level}", f"gram_counts{level}", keys[order])[:, 0]
        return np.maximum(counts - d[np.minimum(counts, 3)], 0) / safe + spare * shorter

    def score(self, texts: list[bytes]) -> pd.DataFrame:
        """Tokens, known tokens, add-one and Kneser-Ney log10 probability of each text."""
        words, order = self.words, max(self.gram_discounts)
        numbers, count, sizes = _grams(texts, words, order)
        begin = np.cumsum(sizes) - sizes
        base = np.log10((count + 1) / (words.total + words.distinct + 1))
        distinct, where = np.unique(numbers[-1], return_inverse=True)
        p = self.of_words(distinct)[where]
        for level in range(2, order + 1):
            p = self._of_grams(numbers[-level:], p)
        return pd.DataFrame(
            {
                "n_tokens": sizes,
                "n_known": np.add.reduceat((count > 0).astype(np.int64), begin),
                "base_score": np.add.reduceat(base, begin),
                "score": np.add.reduceat(np.log10(p), begin),
            }
        )


def train(texts: DataFrame, bucket_bytes: int = BUCKET_BYTES, order: int = ORDER) -> KneserNey:
    """A model of a table with one binary column of texts, in a new shared folder.

    Every token of every text is counted. The number of buckets follows the bytes of
    text and the order, so a bucket's arrays stay of one size however large the corpus;
    repeated rows count each time, and an empty table gives a model that knows nothing.
    Files are whole when they appear, and a task that runs again writes the same.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    buckets = max(1, -(-size * order // (2 * bucket_bytes)))
    words = count_words(texts, new_folder(spark, "kneser-ney"), buckets)
    places = spark.range(buckets).selectExpr(
        "'none' AS kind", "CAST(id AS int) AS bucket", "CAST(NULL AS binary) AS data"
    )

    def part_of(level: int):
        def part(rows: pd.DataFrame) -> pd.DataFrame:
            return pa.Table.from_batches(list(_gram_part(rows, words, order, level))).to_pandas()

        return part

    sent = texts.mapInArrow(lambda b: _gram_rows(b, words, order), BUCKET_ROWS)
    for level in range(order, 1, -1):
        sent = sent.unionByName(places).groupBy("bucket").applyInPandas(part_of(level), BUCKET_ROWS)
    parts = (
        sent.unionByName(places)
        .groupBy("bucket")
        .applyInPandas(lambda rows: _word_part(rows, words), "kind string, sums array<bigint>")
        .groupBy("kind")
        .agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"n{k}") for k in range(6)])
        .collect()
    )
    sums = {r["kind"]: np.array([r[f"n{k}"] or 0 for k in range(6)], float) for r in parts}
    left = sums["left"]
    return KneserNey(
        words,
        {level: discounts(sums[f"seen{level}"]) for level in range(2, order + 1)},
        discounts(left),
        int(left[5]),
        np.array([left[0], left[1], left[4]], float),
    )


def score_texts(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_known``, ``base_score``, ``score`` and ``perplexity``.

    Scores are log10 probabilities of the whole text and its end; a NULL or empty
    text is its end alone. Columns with the names of the results are replaced.
    """

    @F.pandas_udf("n_tokens bigint, n_known bigint, base_score double, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.concat([model.score(own) for own in _chunks(texts)], ignore_index=True)

    results = ("n_tokens", "n_known", "base_score", "score", "perplexity")
    found = packed(docs.drop(*results)).withColumn("found", score(text_bytes("row.text")))
    return found.select(
        "row.*",
        "found.*",
        F.pow(F.lit(10.0), -F.col("found.score") / F.col("found.n_tokens")).alias("perplexity"),
    )


def language_model_digest(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document: counts and scores under the model of the rows that are not held out."""
    model = train(docs.filter(~held_out()).select(text_bytes("text").alias("text")), order=order)
    return score_texts(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.words.total).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )
