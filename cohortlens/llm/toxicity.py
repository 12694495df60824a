"""Toxicity: a convolutional text classifier over hashed word embeddings, made with numpy."""

from __future__ import annotations

import pickle
import warnings
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD_BYTES, id_text, packed, text_bytes

#: Most labelled rows, most bytes of their texts, and of one text, that a fit takes.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 96 << 20
SAMPLE_TEXT = 4 << 20
#: Hash buckets of words; an embedding needs so many of the fitted texts.
BUCKETS = 1 << 22
LEAST_TEXTS = 3
#: Numbers of an embedding, filter widths in words, filters of each width.
SIZE, WIDTHS, FILTERS = 16, (1, 2, 3), 16
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.1, 7
#: Every so many of the sample's rows calibrate thresholds instead of fitting.
CALIBRATE = 5
#: A language needs so many toxic and clean rows there for a threshold of its own.
LEAST_OF_LANGUAGE = 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.pmod(F.crc32(id_text(doc_id).cast("binary")), F.lit(5)) == 0


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class WordRows(dict):
    """A number by word, filled on demand and of bounded size: the word's bucket, or,
    where embedding ``rows`` by bucket are given, its row (0 for words without one)."""

    def __init__(self, rows: dict[int, int] | None = None, most: int = 300_000) -> None:
        super().__init__()
        self.rows, self.most = rows, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = bucket(word)
        self[word] = found = found if self.rows is None else self.rows.get(found, 0)
        return found

    def text(self, text: bytes) -> np.ndarray:
        words = text.translate(WORD_BYTES).split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


#: Each filter is a row of numbers for each of its words, a tap: filter and place of each tap.
FILTER_OF_TAP = np.concatenate([np.tile(np.arange(FILTERS), w) + FILTERS * k for k, w in enumerate(WIDTHS)])
PLACE_OF_TAP = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])
#: Positions of a text that are compared with the filters at a time.
BLOCK = 1 << 15


@dataclass
class Model:
    """Embeddings (row 0 is zero), filters by tap, their biases, and the logistic output."""

    buckets: np.ndarray
    embedding: np.ndarray
    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self) -> WordRows:
        return WordRows({int(b): i + 1 for i, b in enumerate(self.buckets)})

    def peaks(self, rows: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter to a text of ``words`` words, and its position.

        ``rows`` is padded by zeros to the widest filter; a text shorter than a filter
        has one position for it.
        """
        best = np.full(len(self.bias), -np.inf, np.float32)
        places = np.zeros(len(self.bias), np.int64)
        for begin in range(0, max(words, 1), BLOCK):
            part = rows[begin : begin + BLOCK + max(WIDTHS) - 1]
            seen = self.taps @ self.embedding[part].T
            tap = 0
            for k, width in enumerate(WIDTHS):
                n = min(max(words - width + 1, 1) - begin, BLOCK)
                if n > 0:
                    total = seen[tap : tap + FILTERS, :n]
                    for j in range(1, width):
                        total = total + seen[tap + j * FILTERS : tap + (j + 1) * FILTERS, j : j + n]
                    own = slice(k * FILTERS, (k + 1) * FILTERS)
                    at = total.argmax(axis=1)
                    value = total[np.arange(FILTERS), at]
                    more = value > best[own]
                    best[own] = np.where(more, value, best[own])
                    places[own] = np.where(more, at + begin, places[own])
                tap += width * FILTERS
        return best, places

    def logit(self, rows: np.ndarray) -> float:
        best, _ = self.peaks(_padded(rows), len(rows))
        return float(np.maximum(best + self.bias, 0) @ self.out[:-1] + self.out[-1]) - self.shift


def _padded(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.zeros(max(max(WIDTHS) - len(rows), 0), rows.dtype)])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: Sequence[np.ndarray], labels: np.ndarray, embeddings: int) -> Model:
    """Filters, embeddings and output by Adagrad on the logistic loss.

    The gradient of a pooled filter goes to the words at its largest response only.
    """
    rng = np.random.default_rng(SEED)
    filters = FILTERS * len(WIDTHS)
    embedding = rng.normal(0, 0.02, (embeddings + 1, SIZE)).astype(np.float32)
    embedding[0] = 0
    start = [rng.normal(0, 0.3, (w, SIZE, FILTERS)).transpose(0, 2, 1).reshape(-1, SIZE) for w in WIDTHS]
    taps = np.concatenate(start).astype(np.float32)
    out = np.append(rng.normal(0, 0.3, filters), _prior(labels)).astype(np.float32)
    model = Model(np.zeros(0, np.int64), embedding, taps, np.zeros(filters, np.float32), out)
    params = [model.embedding, model.taps, model.bias, model.out]
    memory = [np.full(p.shape, 1e-6, np.float32) for p in params]
    texts, sizes = [_padded(t) for t in texts], [len(t) for t in texts]
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            part = order[begin : begin + BATCH]
            z = np.empty((len(part), filters), np.float32)
            hit = np.empty((len(part), len(FILTER_OF_TAP)), np.int32)
            for at, i in enumerate(part):
                z[at], places = model.peaks(texts[i], sizes[i])
                hit[at] = texts[i][places[FILTER_OF_TAP] + PLACE_OF_TAP]
            z += model.bias
            features = np.append(np.maximum(z, 0), np.ones((len(part), 1), np.float32), axis=1)
            slope = ((_sigmoid(features @ model.out) - labels[part]) / len(part)).astype(np.float32)
            down = slope[:, None] * model.out[:-1] * (z > 0)
            by_tap = down[:, FILTER_OF_TAP]
            grads = [
                np.einsum("bt,bts->ts", by_tap, model.embedding[hit]),
                down.sum(axis=0),
                slope @ features,
            ]
            row_grads = (by_tap[:, :, None] * model.taps).reshape(-1, SIZE)
            for p, m, g in zip(params[1:], memory[1:], grads, strict=True):
                m += g * g
                p -= RATE * g / np.sqrt(m)
            touched, where = np.unique(hit.ravel(), return_inverse=True)
            total = np.zeros((len(touched), SIZE), np.float32)
            np.add.at(total, where, row_grads)
            total[touched == 0] = 0
            memory[0][touched] += total * total
            model.embedding[touched] -= RATE * total / np.sqrt(memory[0][touched])
    return model


def _prior(labels: np.ndarray) -> float:
    rate = (labels.sum() + 1) / (len(labels) + 2)
    return float(np.log(rate / (1 - rate)))


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the largest F1, in the middle of the gap that gives it."""
    order = np.argsort(-logits, kind="stable")
    logits, labels = logits[order], labels[order]
    hits = np.cumsum(labels)
    f1 = 2 * hits / (np.arange(1, len(labels) + 1) + labels.sum())
    last = np.flatnonzero(np.append(logits[1:] != logits[:-1], True))
    at = last[np.argmax(f1[last])]
    return float(logits[at] if at + 1 == len(logits) else (logits[at] + logits[at + 1]) / 2)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = SAMPLE_ROWS,
    size: int = SAMPLE_BYTES,
    longest: int = SAMPLE_TEXT,
) -> DataFrame:
    """(buckets, lang, toxic, place) of at most ``rows`` labelled rows and ``size`` bytes of text.

    Taken in the order of a hash of the id, from rows that are not held out; texts of
    more than ``longest`` bytes are passed over, they are scored but not learned from. A
    document labelled both ways counts as toxic. ``buckets`` holds the buckets of the
    words as 32-bit numbers.
    """

    @F.pandas_udf("binary")
    def buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordRows()
        for texts in batches:
            yield pd.Series([known.text(t).tobytes() for t in texts], dtype=object)

    ids = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", text_bytes("text").alias("text"), "lang").join(
        F.broadcast(ids), "doc_id"
    ).filter(F.octet_length("text") <= longest)
    order = Window.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
    return (
        found.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
        .limit(rows)
        .withColumn("_upto", F.sum(F.octet_length("text")).over(order))
        .filter(F.col("_upto") <= size)
        .select(buckets("text").alias("buckets"), "lang", "toxic", F.col("_upto").alias("place"))
    )


def _places(values: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1-based places in the sorted ``kept``, 0 for values that it lacks."""
    if not len(kept):
        return np.zeros(values.shape, np.int32)
    at = np.minimum(np.searchsorted(kept, values), len(kept) - 1)
    return np.where(kept[at] == values, at + 1, 0).astype(np.int32)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled sample, with a threshold for each language.

    A fifth of the sample is kept from the fit: on it the score is shifted so that
    0.5 is the best cut, and each language with enough rows of both kinds gets its
    own cut. None, with a warning, where the sample lacks toxic or clean rows.
    """
    found = (
        labelled_sample(docs, labels)
        .withColumn("all", F.lit("all"))
        .groupBy("all")
        .applyInPandas(_trained, "model binary")
        .collect()
    )
    if not found:
        warnings.warn("too few labelled rows of both kinds: no model, all scores are 0", stacklevel=2)
        return None
    return Model(**pickle.loads(found[0]["model"]))


def _trained(rows: pd.DataFrame) -> pd.DataFrame:
    """The pickled fields of a model of the sample, which is bounded, in one task."""
    model = _train(rows)
    return pd.DataFrame({"model": [pickle.dumps(vars(model))] if model else []})


def _train(rows: pd.DataFrame) -> Model | None:
    rows = rows.sort_values("place", ignore_index=True)
    toxic = rows["toxic"].to_numpy(float)
    if len(rows) < 10 or toxic.min() == toxic.max():
        return None
    fitted = np.arange(len(rows)) % CALIBRATE > 0
    if toxic[fitted].min() == toxic[fitted].max():
        return None
    words = [np.frombuffer(b, np.int32) for b in rows["buckets"]]
    own = [np.unique(w) for w, f in zip(words, fitted, strict=True) if f]
    seen, count = np.unique(np.concatenate(own), return_counts=True)
    kept = seen[count >= LEAST_TEXTS].astype(np.int64)
    texts = [_places(w, kept) for w in words]
    model = fit([t for t, f in zip(texts, fitted, strict=True) if f], toxic[fitted], len(kept))
    model.buckets = kept
    other = np.flatnonzero(~fitted)
    logits = np.array([model.logit(texts[i]) for i in other])
    truth = toxic[other]
    if truth.min() < truth.max():
        model.shift = best_threshold(logits, truth)
        langs = np.array([lang or "" for lang in rows["lang"].iloc[other]])
        for lang in np.unique(langs):
            own = langs == lang
            if min(truth[own].sum(), (1 - truth[own]).sum()) >= LEAST_OF_LANGUAGE:
                cut = best_threshold(logits[own], truth[own]) - model.shift
                model.thresholds[str(lang)] = float(_sigmoid(cut))
    return model


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``threshold`` of the language and ``rejected``.

    The score comes from the words of the whole text alone; an empty or NULL text
    gets the score of no words, and all texts get 0 where there is no model. Unknown
    and NULL languages have the threshold 0.5. Long texts are compared whole, in blocks
    of positions; equal texts score the same; an empty table gives no rows. Columns with
    the names of the results are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(None if model is None else vars(model))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = held.value and Model(**held.value)
        rows = made.rows() if made else None
        for texts in batches:
            values = [_sigmoid(made.logit(rows.text(t))) if made else 0.0 for t in texts]
            yield pd.Series(values, dtype=float)

    threshold = F.lit(0.5)
    for lang, cut in sorted((model.thresholds if model else {}).items()):
        threshold = F.when(F.col("row.lang") == lang, cut).otherwise(threshold)
    rows = packed(docs.drop("score", "threshold", "rejected"))
    return (
        rows.withColumn("score", score(text_bytes("row.text")))
        .withColumn("threshold", threshold if "lang" in docs.columns else F.lit(0.5))
        .withColumn("rejected", F.col("score") >= F.col("threshold"))
        .select("row.*", "score", "threshold", "rejected")
    )


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held out or not, score, the label at 0.5, and the language's decision."""
    scored = score_toxicity(docs.select("doc_id", "text", "lang"), train(docs, labels))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold",
        "rejected",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns unchanged."""
    model = train(docs, labels)
    text = packed(docs).select("row", F.col("row.text").alias("text"))
    lang = F.col("row.lang") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = score_toxicity(text.withColumn("lang", lang), model)
    return scored.filter(~F.col("rejected")).select("row.*")
