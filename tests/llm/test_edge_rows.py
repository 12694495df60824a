"""NULLs, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import (
    decontamination,
    embedding_dedup,
    language_model,
    licenses,
    line_dedup,
    mixing,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
)
from cohortlens.llm.common import text_bytes

LONG = "lorem ipsum dolor\n" * 20_000
ROWS = [
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n", "fr", "a"),
    (4, "One two three\nfour\nfive six", "en", "b"),
    (4, "One two three\nfour\nfive six", "en", "b"),
    (5, "One two three\nfour\nfive six", "de", "a"),
    (None, "No id, no source", "xx", None),
    (None, None, None, None),
    (6, LONG, "en", "b"),
    (7, "été \u0000 \U0001f600 x", "fr", "c"),
]
CLASHING = "score shard slot hash row text_hash n_words items kept spans found key _part take source_size".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "two three four"), (None, "no id no"), (2, None), (3, "")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def score(docs):
    texts = docs.filter(~language_model.held_out()).select(text_bytes("text").alias("text"))
    return language_model.score_texts(docs, language_model.train(texts))


SAME_ROWS = {
    "sharding": lambda d, b: sharding.shard_documents(d),
    "lines": lambda d, b: line_dedup.dedup_lines(d),
    "suffix": lambda d, b: suffix_dedup.dedup_substrings(d),
    "contamination": lambda d, b: decontamination.find_contamination(d, b),
    "licenses": lambda d, b: licenses.scan_licenses(d),
    "toxicity": lambda d, b: toxicity.score_toxicity(d, None),
    "language model": lambda d, b: score(d),
}


@pytest.mark.parametrize("name", sorted(SAME_ROWS))
def test_every_row_stays(docs, bench, name):
    out = SAME_ROWS[name](docs, bench)
    assert out.count() == len(ROWS) and {"doc_id", "text", "lang", "source", "key"} <= set(out.columns)
    out.collect()
    assert SAME_ROWS[name](docs.limit(0), bench).collect() == []


def test_near_duplicates(docs):
    ids = [r["doc_id"] for r in simhash.dedup_simhash(docs).collect()]
    # The rows without words are one group, the equal texts another.
    assert sorted(i for i in ids if i is not None) == [1, 4, 6, 7] and ids.count(None) == 1
    assert simhash.dedup_simhash(docs.limit(0)).collect() == []


def test_contaminated_rows_go(docs, bench):
    ids = [r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 6, 7] and ids.count(None) == 1
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == len(ROWS)


def test_mixing(docs):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert max(r["count"] for r in out.groupBy("doc_id", "source", "lang").count().collect()) <= 6
    assert mixing.mix_documents(docs.limit(0)).collect() == []


def test_lines_of_equal_rows(docs):
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs.filter("doc_id > 3")).collect()}
    assert got[4] == 0 and got[5] == 3 and got[6] == 19_999


def test_repeats_of_equal_rows(spark):
    text = "x" * 10 + "".join(chr(97 + i * i % 23) for i in range(500))
    rows = spark.createDataFrame([(1, text), (1, text), (2, "short"), (None, None)], "doc_id bigint, text string")
    got = [(r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup_substrings(rows).collect()]
    assert sorted(got, key=str) == [(1, 510, 1), (1, 510, 1), (2, 0, 0), (None, 0, 0)]


def test_vectors_of_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1, "x"),
        (1, [1.0, 0.0], 1, "y"),
        (2, [2.0, 0.1], 1, "x"),
        (3, [1.0, 0.0], None, "x"),
        (None, [0.0, 1.0], 1, "x"),
        (4, [0.0, 1.0], 1, "x"),
        (5, None, 1, "x"),
        (6, [], 1, "x"),
        (7, [0.0, 0.0], 1, "x"),
        (8, [1.0, None], 1, "x"),
        (9, [1.0, float("inf")], 1, "x"),
        (10, [1.0], 1, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, note string")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("cid", "n", "first", "dim", "vector", "root", "kept", "component")])
    out = embedding_dedup.dedup_embeddings(df)
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out.collect())
    assert got == sorted(
        [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (0, 1, 4, True), (4, 1, 4, True)]
        + [(i, 0, i, True) for i in range(5, 11)]
    )
    assert {"note", "cid", "vector", "root"} <= set(out.columns)
    assert embedding_dedup.dedup_embeddings(df.limit(0)).collect() == []


def test_trained_model_on_odd_rows(spark, docs):
    words = ["good day to you", "bad vile words here"]
    fitted = spark.createDataFrame(
        [(i, f"{words[i % 2]} {i % 7}", "en") for i in range(200)], "doc_id bigint, text string, lang string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    model = toxicity.train(fitted, labels)
    out = toxicity.score_toxicity(docs, model)
    assert out.count() == len(ROWS) and {"score", "row", "key"} <= set(out.columns)
    scores = {(r["doc_id"], r["text"]): r["score"] for r in out.collect()}
    # The odd rows collapse to their (doc_id, text): rows 4 and 4 are equal.
    assert len(scores) == len(ROWS) - 1 and all(0 <= s <= 1 for s in scores.values())
    assert scores[1, None] == scores[2, ""] == scores[3, " \t\n"] == scores[None, None]
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []
    learned = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(fitted, model).collect()}
    assert all((learned[i] >= 0.5) == bool(i % 2) for i in range(200))


def test_training_needs_both_labels(spark, docs):
    labels = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id bigint, toxic int")
    assert toxicity.train(docs, labels) is None
    assert toxicity.train(docs, labels.limit(0)) is None


def test_pipeline_of_an_empty_table(spark, docs, bench, tmp_path):
    folder = str(tmp_path)
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
