"""Ranked lexical search: best-first document intervals over range-maximum tables.

The index is a Parquet table of segments, each with its own documents and posting
lists, so it grows by rows and no list is ever whole in one place. A search visits the
segments one by one, and the best documents of the segments are ranked together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cohortlens.llm.common import BROADCAST_ROWS, WORD_BYTES, cut, is_small, new_folder, text_bytes

#: Postings after which a segment is closed: what a search task holds at a time.
SEGMENT_POSTINGS = 2_000_000
#: Distinct (item, term) pairs that are searched at once.
BLOCK_PAIRS = 200_000
#: Rows of the index in one Arrow batch.
BATCH_TERMS = 20_000
#: Intervals of a query that are split in one step.
SPLITS = 48
#: Documents returned for an item.
K = 50

_DOC = np.uint64(32)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class _OpenSegment:
    """Documents and terms of a segment that still grows."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.distinct: list[int] = []
        self.terms: list[bytes] = []
        self.tfs: list[int] = []

    def add(self, key, text: bytes) -> None:
        words = terms_of(text)
        counts = Counter(words)
        self.ids.append(key)
        self.lengths.append(len(words))
        self.distinct.append(len(counts))
        self.terms.extend(counts.keys())
        self.tfs.extend(counts.values())

    def rows(self, segment: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """First the row of the documents, by rising id, then the posting lists."""
        ids = pa.array(self.ids, schema.field("ids").type.value_type)
        order = pc.sort_indices(ids).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        lengths = np.array(self.lengths, np.int32)[order]
        yield _index_batch(schema, segment, [None], [0, len(order)], np.arange(len(order)), lengths, ids.take(pa.array(order)))
        found = pa.array(self.terms, pa.binary()).dictionary_encode()
        number = found.indices.to_numpy()
        docs = np.repeat(rank, self.distinct)
        by_term = np.lexsort((docs, number))
        docs, tfs = docs[by_term], np.array(self.tfs, np.int32)[by_term]
        ends = np.cumsum(np.bincount(number, minlength=len(found.dictionary)))
        terms = [t.decode(errors="replace") for t in found.dictionary.to_pylist()]
        for at in range(0, len(terms), BATCH_TERMS):
            some = terms[at : at + BATCH_TERMS]
            begin = ends[at - 1] if at else 0
            offsets = np.concatenate([[begin], ends[at : at + len(some)]])
            own = slice(begin, offsets[-1])
            yield _index_batch(schema, segment, some, offsets - begin, docs[own], tfs[own], None)


def _index_batch(schema, segment, terms, offsets, docs, tfs, ids) -> pa.RecordBatch:
    offsets = pa.array(np.asarray(offsets, np.int32))
    if ids is None:
        keys = pa.nulls(len(terms), schema.field("ids").type)
    else:
        keys = pa.ListArray.from_arrays(offsets, ids).cast(schema.field("ids").type)
    columns = [
        pa.array(np.full(len(terms), segment, np.int64)),
        pa.array(terms, pa.string()),
        pa.ListArray.from_arrays(offsets, pa.array(docs.astype(np.int32))),
        pa.ListArray.from_arrays(offsets, pa.array(tfs.astype(np.int32))),
        keys,
    ]
    return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])


def build_index(docs: DataFrame, key: str = "doc_id", segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """The search index of all ``docs``, as a table in the shared folder.

    Columns: ``segment``, ``term``, ``docs`` (rising numbers of documents in the
    segment), ``tfs`` (occurrences), ``ids``. A segment's row without term lists its
    documents by rising key: ``ids``, and their numbers of terms in ``tfs``. Each task
    closes a segment when it holds so many postings; a text is never cut. NULL and
    empty texts are documents without terms. The order of the rows decides which
    segment a document is in, not how it is ranked.
    """
    rows = docs.select(F.col(key).alias("key"), text_bytes("text").alias("text"))
    kind = rows.schema["key"].dataType
    schema = StructType(
        [
            StructField("segment", LongType()),
            StructField("term", StringType()),
            StructField("docs", ArrayType(IntegerType())),
            StructField("tfs", ArrayType(IntegerType())),
            StructField("ids", ArrayType(kind)),
        ]
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, number = _OpenSegment(), TaskContext.get().partitionId() << 32
        arrow = None
        for batch in batches:
            if arrow is None:
                ints = pa.list_(pa.int32())
                arrow = pa.schema(
                    [("segment", pa.int64()), ("term", pa.string()), ("docs", ints), ("tfs", ints)]
                    + [("ids", pa.list_(batch.schema.field("key").type))]
                )
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, own in enumerate(keys):
                open_.add(own, texts[i].as_py())
                if len(open_.terms) >= segment_postings:
                    yield from open_.rows(number, arrow)
                    open_, number = _OpenSegment(), number + 1
        if open_.ids:
            yield from open_.rows(number, arrow)

    return cut(rows.mapInArrow(segments, schema), "search-index")


class Segment:
    """Posting lists laid end to end, with a sparse table of maxima over the impacts.

    ``top[level][i]`` is the place of the largest impact among the 2**level postings
    from ``i``, the first of equal ones. A range within one list is covered by two
    overlapping entries, so its maximum takes two lookups. Entries that reach into the
    next list are never read.
    """

    def __init__(self, lists: Sequence[np.ndarray], impacts: Sequence[np.ndarray]) -> None:
        sizes = [len(one) for one in lists]
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.docs = np.concatenate(lists).astype(np.int64)
        self.impact = np.concatenate(impacts)
        number = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        self.keys = number << _DOC | self.docs.astype(np.uint64)
        self.top = [np.arange(len(self.docs), dtype=np.int32)]
        for level in range(1, max(sizes).bit_length()):
            below, half = self.top[-1], 1 << (level - 1)
            left, right = below[:-half], below[half:]
            self.top.append(np.where(self.impact[left] >= self.impact[right], left, right))

    def maxima(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the largest impacts in ranges of postings; -1 for empty ranges."""
        size = end - begin
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.full(size.shape, -1, np.int32)
        for one in range(level.max(initial=-1) + 1):
            at = np.nonzero(level == one)
            a, b = self.top[one][begin[at]], self.top[one][end[at] - (1 << one)]
            out[at] = np.where(self.impact[a] >= self.impact[b], a, b)
        return out

    def best(self, lists: np.ndarray, n_docs: int, k: int, splits: int = SPLITS) -> list[tuple[int, int]]:
        """(score, document) of the ``k`` best by the sum of the lists' impacts, ties by number.

        An interval of documents is bounded by the sum over lists of the largest
        impact in it. The intervals with the highest bounds are split at the document
        of their largest impact, which is scored; what lies on either side gets a bound of
        its own. The search ends when no interval can hold a document among the best.
        """
        number = lists.astype(np.uint64) << _DOC
        low, high = np.zeros(1, np.int64), np.full(1, n_docs, np.int64)
        begin, end = self.begins[lists][None, :], self.ends[lists][None, :]
        bound, split = self._bounds(begin, end)
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            if len(bound) > splits:
                take = np.zeros(len(bound), bool)
                take[np.argpartition(-bound, splits - 1)[:splits]] = True
            else:
                take = np.ones(len(bound), bool)
            doc, lo, hi, i, j = split[take], low[take], high[take], begin[take], end[take]
            at = np.searchsorted(self.keys, number[None, :] | doc[:, None].astype(np.uint64))
            hit = (at < j) & (self.docs[np.minimum(at, len(self.docs) - 1)] == doc[:, None])
            own = np.where(hit, self.impact[np.minimum(at, len(self.docs) - 1)], 0).sum(axis=1)
            scores, found = np.concatenate([scores, own]), np.concatenate([found, doc])
            first = np.lexsort((found, -scores))[:k]
            scores, found = scores[first], found[first]

            begins, ends = np.concatenate([i, at + hit]), np.concatenate([at, j])
            bounds, splits_at = self._bounds(begins, ends)
            low = np.concatenate([low[~take], lo, doc + 1])
            high = np.concatenate([high[~take], doc, hi])
            begin, end = np.concatenate([begin[~take], begins]), np.concatenate([end[~take], ends])
            bound, split = np.concatenate([bound[~take], bounds]), np.concatenate([split[~take], splits_at])
            if len(scores) < k:
                open_ = bound > 0
            else:
                open_ = (bound > scores[-1]) | ((bound == scores[-1]) & (low < found[-1]))
            low, high, begin, end = low[open_], high[open_], begin[open_], end[open_]
            bound, split = bound[open_], split[open_]
        return [(int(s), int(d)) for s, d in zip(scores, found, strict=True) if s > 0]

    def _bounds(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each interval, and the document to split it at."""
        place = self.maxima(begin, end)
        impact = np.where(place >= 0, self.impact[place], 0)
        best = np.take_along_axis(place, impact.argmax(axis=1)[:, None], axis=1)[:, 0]
        return impact.sum(axis=1), self.docs[best]


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts_of(weight: int, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    tfs = tfs.astype(np.int64)
    return weight * (1_000_000_000 * tfs // (1000 * tfs + 20 * m))


def length_norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """50 plus 50 times a document's length over the mean, in whole numbers of any size."""
    different, place = np.unique(lengths, return_inverse=True)
    norms = [50 + 50 * int(n) * n_docs // n_terms for n in different]
    return np.array(norms, np.int64)[place]


def search_segment(
    rows: pd.DataFrame,
    queries: dict[object, list[str]],
    weights: dict[str, int],
    n_docs: int,
    n_terms: int,
    k: int,
) -> Iterator[tuple[object, object, int]]:
    """(item, id, score) of the best documents of one segment for each item."""
    head = rows["term"].isna()
    if not head.any():
        return
    ids, lengths = rows.loc[head, "ids"].iloc[0], np.asarray(rows.loc[head, "tfs"].iloc[0])
    norms = length_norms(lengths, n_docs, n_terms)
    lists, impacts, place = [], [], {}
    for term, docs, tfs in rows.loc[~head, ["term", "docs", "tfs"]].itertuples(index=False):
        if weights.get(term, 0) > 0:
            place[term] = len(lists)
            lists.append(np.asarray(docs))
            impacts.append(impacts_of(weights[term], np.asarray(tfs), norms[lists[-1]]))
    if not lists:
        return
    segment = Segment(lists, impacts)
    for item, terms in queries.items():
        own = [place[t] for t in terms if t in place]
        if own:
            for score, doc in segment.best(np.array(own), len(lengths), k):
                yield item, ids[doc], score


def query_terms(queries: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, term): the distinct terms of each item; rows of one id are one item."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([[t.decode(errors="replace") for t in set(terms_of(x))] for x in texts], dtype=object)

    return queries.select(F.col(item).alias("item"), F.explode(split(text_bytes("text"))).alias("term")).distinct()


def search(
    index: DataFrame, queries: DataFrame, k: int = K, item: str = "item_id", block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """(item, rank, id, score): the ``k`` best documents of each item, equal scores by rising id.

    Items go to the segments in blocks of about ``block_pairs`` (item, term) pairs,
    each block one pass over the posting lists of its terms. A segment gives up to
    ``k`` documents an item, and the best of all segments are chosen by a window that
    cuts before its shuffle. Items without a term in the corpus, and an empty index,
    give no row. Documents without id rank behind equal ones with id.
    """
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType
    stats = index.filter("term IS NULL").agg(
        F.sum(F.size(F.filter("tfs", lambda n: n > 0))),
        F.sum(F.aggregate("tfs", F.lit(0).cast("bigint"), lambda s, n: s + n)),
    )
    n_docs, n_terms = (int(v or 0) for v in stats.first())
    pairs = cut(query_terms(queries, item), "search-terms")
    vocabulary = cut(pairs.select("term").distinct(), "search-vocabulary")
    wanted = F.broadcast(vocabulary) if is_small(vocabulary, BROADCAST_ROWS) else vocabulary
    postings = index.join(wanted, "term", "left_semi")
    known = cut(postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df")), "search-df")
    pairs = cut(pairs.join(known, "term"), "search-pairs")
    blocks = max(1, -(-pairs.count() // block_pairs))
    item_type = pairs.schema["item"].dataType
    found_schema = StructType(
        [StructField("item", item_type), StructField("id", kind), StructField("score", LongType())]
    )
    heads = index.filter("term IS NULL").select("segment", "term", "docs", "tfs", "ids")
    paths = []
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        by_item: dict[object, list[str]] = {}
        weights: dict[str, int] = {}
        for r in own.orderBy("item", "term").toLocalIterator():
            by_item.setdefault(r["item"], []).append(r["term"])
            weights[r["term"]] = term_weight(n_docs, r["df"])
        if not by_item:
            continue
        held = spark.sparkContext.broadcast((by_item, weights))
        terms = own.select("term").distinct()
        terms = F.broadcast(terms) if len(weights) <= BROADCAST_ROWS else terms
        lists = index.join(terms, "term", "left_semi").select("segment", "term", "docs", "tfs", "ids")
        paths.append(new_folder(spark, "search-found"))
        lists.unionByName(heads).groupBy("segment").applyInPandas(
            _searcher(held, n_docs, n_terms, k), found_schema
        ).write.parquet(paths[-1])
        held.destroy()
    found = (
        spark.read.schema(found_schema).parquet(*paths) if paths else spark.createDataFrame([], found_schema)
    )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("item", "rank", "id", "score")
    )


def _searcher(held, n_docs: int, n_terms: int, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by_item, weights = held.value
        found = list(search_segment(rows, by_item, weights, n_docs, n_terms, k))
        return pd.DataFrame(found, columns=["item", "id", "score"], dtype=object)

    return run


def lexical_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    found = search(build_index(docs), benchmark)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
