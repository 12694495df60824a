"""The operators against plain Python versions, and their queries against SQL."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import (
    decontamination,
    embedding_dedup,
    induced_sort,
    language_model,
    licenses,
    line_dedup,
    mixing,
    queries,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
)
from cohortlens.llm.common import cut
from cohortlens.llm.components import components
from cohortlens.llm.shared_arrays import pack
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) == []


def roots_of(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def texts_of(spark, folder, n=None):
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    return [(r["doc_id"], (r["text"] or "").encode()) for r in rows][:n]


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(5, 5)]
    want = roots_of(200, links)
    got = components(spark.createDataFrame(links, "a bigint, b bigint"))
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["vertex"]: r["root"] for r in got.collect()} == {x: want[x] for x in linked}


def test_sharding(spark, sf_dir):
    rows = queries.op4_sharding(spark, sf_dir).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(slots) < 40
    assert 0 < sum(r["grown_shard"] == 40 for r in rows) < len(rows) / 10
    def winner(doc_id, shards):
        seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        draws = [(xxhash.xxh64_intdigest(struct.pack("<i", k), seed) >> 11) for k in range(shards)]
        return min(range(shards), key=lambda k: (-math.log((draws[k] + 0.5) * 2.0**-53), k))

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, text in documents:
        raw = (text or "").encode()
        want.append((d, len(raw) + 16, zlib.crc32(raw), "key", winner(d, 40), winner(d, 41)))
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    heavy = sharding.assign_shards(spark.range(20_000), "id", [1.0, 3.0, 0.0])
    share = {r["shard"]: r["count"] / 20_000 for r in heavy.groupBy("shard").count().collect()}
    assert set(share) == {0, 1} and abs(share[1] - 0.75) < 0.02


def reshared(sizes, weights=(5, 2, 1), most=3):
    """Targets by giving the excess to the sources below their limit, again and again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full, total = set(), sum(sizes)
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        free = sum(x for i, x in enumerate(w) if i not in full)
        target = [most * s if i in full else rest * w[i] / free for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and target[i] > most * s + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 900, 5, 70, 3, 0, 1000], [0, 0], [7], [1, 1, 5000, 1, 1, 1]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size bigint"))
    want = reshared(sizes)
    assert [r["target"] for r in got.orderBy("source").collect()] == pytest.approx(want)


def test_words_before_a_last_line_separator(frame):
    texts = ["abc \u0085", "abc \u2028", "a b \u2029", " abc \n", "abc \u0085 ", "abc\u0085", " \u2028", " ", ""]
    docs = frame("doc_id bigint, text string", list(enumerate(texts)))
    got = [r[0] for r in docs.orderBy("doc_id").select(mixing.word_count(F.col("text"))).collect()]
    assert got == [2, 2, 3, 1, 2, 1, 1, 0, 0]


def test_mixing_meets_targets(spark, sf_dir):
    rows = queries.op6_mixing(spark, sf_dir).collect()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        own = by[r["source_size"], r["target"]]
        own[0], own[1], own[2] = own[0] + r["taken"], r["target"], max(own[2], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(t - most <= taken <= t + 1e-6 for taken, t, most in by.values())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    taken = sum(r["taken"] // r["size"] for r in rows if r["size"])
    assert mixed.filter(mixing.word_count(F.col("text")) > 0).count() == taken


def test_decontamination_of_short_items_and_overlaps(spark, frame):
    rnd = random.Random(5)
    words = [[rnd.choice("abcd") for _ in range(rnd.choice([0, 3, 40, 200]))] for _ in range(40)]
    items = [[rnd.choice("abcd") for _ in range(n)] for n in (0, 2, 5, 6, 10, 11, 14)] + [["A", "b!", "c"]]
    docs = frame("doc_id bigint, text string", [(i, " ".join(w)) for i, w in enumerate(words)])
    bench = frame("item_id bigint, text string", [(i, "-".join(w)) for i, w in enumerate(items)])
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, bench, part_bytes=20).collect()}
    items[-1] = ["a", "b", "c"]
    for i, w in enumerate(words):
        hit, found = set(), set()
        for k, item in enumerate(items):
            m = min(10, len(item))
            windows = {tuple(item[j : j + m]) for j in range(len(item) - m + 1)} if item else set()
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
                    found.add(str(k))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(w), len(hit), sorted(found))


@pytest.mark.parametrize("met", [0, 400])
def test_decontamination_by_a_large_benchmark(spark, frame, monkeypatch, met):
    rnd = random.Random(7)
    item = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    docs = [" ".join(f"v{rnd.randrange(50)}" for _ in range(30)) for _ in range(50)]
    docs += [" ".join(item[i : i + 12]) for i in range(0, met, 8)]
    docs = frame("doc_id bigint, text string", list(enumerate(docs)))
    bench = frame("item_id bigint, text string", [(1, " ".join(item)), (2, " ".join(item[:40]))])
    held, inner = [], decontamination._held
    monkeypatch.setattr(decontamination, "_held", lambda pairs: held.append(pairs.count()) or inner(pairs))
    got = decontamination.find_contamination(docs, bench, part_bytes=120_000).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"]) for r in got] == [(30, 0)] * 50 + [(12, 12)] * (met // 8)
    assert [r["items"] for r in got[50:]] == [["1", "2"] if i < 31 else ["1"] for i in range(0, met, 8)]
    # One item of 2,991 windows: no table holds much more than a part, and windows in no text are in none.
    assert max(held) < 200 and (sum(held) < 250 if met else held == [0])


def plain_fingerprint(text):
    words = text.lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(1, len(words))))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    docs = texts_of(spark, SMALL)
    prints = [plain_fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = roots_of(len(docs), links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SMALL).collect()}
    assert got == {d: (f"{p:016x}", docs[r][0]) for (d, _), p, r in zip(docs, prints, roots, strict=True)}


def test_every_link_within_three_bits_is_found(spark):
    rnd = random.Random(9)
    prints = {0}
    for _ in range(120):
        p = rnd.getrandbits(64)
        prints.add(p)
        for _ in range(rnd.choice([1, 1, 30])):
            prints.add(p ^ sum({1 << rnd.randrange(64) for _ in range(rnd.choice([1, 2, 3, 4]))}))
    prints = sorted(prints)
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print bigint")
    for piece in (4096, 4):
        found = components(simhash.fingerprint_links(df, piece=piece))
        got = {r["vertex"]: r["root"] for r in found.collect()}
        groups = defaultdict(set)
        for i, r in enumerate(roots_of(len(prints), links)):
            groups[r].add(signed[i])
        want = {p: min(g) for g in groups.values() if len(g) > 1 for p in g}
        assert got == want


def test_segments_one_bit_apart_share_a_codeword():
    width = max(simhash.WIDTHS)
    starts, numbers = simhash.near_codewords(width)
    keys = [set(numbers[starts[v] : starts[v + 1]]) for v in range(1 << width)]
    assert all(keys[v] & keys[v ^ (1 << b)] for v in range(1 << width) for b in range(width))


def test_three_errors_leave_a_key_by_any_segments():
    assert sum(simhash.WIDTHS) == 64
    for errors in itertools.product(range(4), repeat=len(simhash.WIDTHS)):
        if sum(errors) <= 3:
            assert any(errors[i] == errors[j] == 0 and errors[k] <= 1 for i, j, k in simhash.CHOICES), errors


def test_rows_of_a_hot_key_are_joined_apart(spark):
    rows = cut(spark.range(6000).selectExpr("id", "IF(id < 2000, 7L, id % 3500) AS root"))
    values = cut(rows.select("root").distinct().selectExpr("root", "-root AS value"))
    got = simhash._joined_by(rows, values, "root")
    assert sorted(r["id"] for r in got.filter("value = -root").collect()) == list(range(6000))


def test_license_places_and_errors():
    notices = [licenses.Notice(p, label) for p, label in licenses.NOTICES.items()]
    text = b"Smit license? MIT License, the mit-license. General Public License / apache  license"
    n, places, _ = licenses.scan(text, licenses.BASE, notices)
    assert n == 12 and sorted(places) == [("apache", 10), ("gpl", 7), ("mit", 2), ("mit", 5)]
    edited = b"Foo. Permision is hereby grantd, free of charge to any prson obtaining a copy! bar"
    _, places, spans = licenses.scan(edited, licenses.BASE, notices)
    assert places == [] and [(s["label"], s["edits"], s["begin"]) for s in spans] == [("mit", 3, 1)]
    assert licenses.scan(b"this work is a permit of charges", licenses.BASE, notices)[2] == []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def edited(rnd, text, edits):
    for _ in range(edits):
        at = rnd.randrange(1, len(text) - 1)
        kind = rnd.choice(["drop", "put", "change"])
        letter = rnd.choice(b"abcdefgh").to_bytes(1, "little")
        text = text[:at] + (b"" if kind == "drop" else letter) + text[at + (kind != "put") :]
    return text


def test_every_edited_notice_is_listed():
    """Notices back to back, with edits, against the distance of each planted and each found text."""
    rnd = random.Random(12)
    for phrase, label in licenses.NOTICES.items():
        notice = licenses.Notice(phrase, label)
        for _ in range(12):
            planted, line = [], b" "
            for _ in range(rnd.choice([2, 5])):
                own = edited(rnd, notice.bytes, rnd.randrange(notice.edits + 1))
                planted.append((len(line), len(line) + len(own), edit_distance(own, notice.bytes)))
                line += own + rnd.choice([b" ", b" x ", b" word or two "])
            found = notice.occurrences(line)
            for begin, end, edits in found:
                assert edits == edit_distance(line[begin:end], notice.bytes) <= notice.edits
            for begin, end, least in planted:
                shared = [(min(e, end) - max(b, begin), n) for b, e, n in found]
                assert any(2 * both > len(notice.bytes) - 2 * notice.edits and n <= least for both, n in shared)
    both = licenses.Notice("all rights reserved", "x").occurrences(b" all rights resrved all rights reserved ")
    assert [(b, e) for b, e, _ in both] == [(1, 19), (20, 39)]


def test_many_seeds_take_linear_time():
    notices = [licenses.Notice(p, label) for p, label in licenses.NOTICES.items()]
    for text in (b"all right permission i " * 45_000, b"all rights reserved mit license " * 32_000):
        start = time.perf_counter()
        licenses.scan(text, licenses.BASE, notices)
        assert time.perf_counter() - start < 30


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, folder).filter("held_out").join(truth, "doc_id").collect()
    hits = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    false = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert hits > 0.8 and false < 0.02


@pytest.mark.parametrize("block", [7, toxicity.BLOCK])
def test_scores_by_a_plain_forward_pass(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [[vocabulary[i] for i in rng.integers(0, 30, n)] for n in rng.integers(0, 60, 60)]
    words = [np.array([toxicity.bucket(w.encode()) for w in t], np.int32) for t in texts]
    rows = pd.DataFrame(
        {"buckets": [w.tobytes() for w in words], "lang": "en", "toxic": ["w3" in t for t in texts], "place": range(60)}
    )
    model = toxicity._train(rows)
    row_of = {int(b): i + 1 for i, b in enumerate(model.buckets)}
    taps = {}
    for tap, (f, j) in enumerate(zip(toxicity.FILTER_OF_TAP, toxicity.PLACE_OF_TAP, strict=True)):
        taps[int(f), int(j)] = model.taps[tap].astype(float)
    known = model.rows()
    for t, w in zip(texts, words, strict=True):
        z = float(model.out[-1]) - model.shift
        for f in range(toxicity.FILTERS * len(toxicity.WIDTHS)):
            width = toxicity.WIDTHS[f // toxicity.FILTERS]
            vectors = [model.embedding[row_of.get(int(b), 0)].astype(float) for b in w]
            vectors += [np.zeros(toxicity.SIZE)] * (width - len(vectors))
            best = max(
                sum(float(vectors[i + j] @ taps[f, j]) for j in range(width)) for i in range(len(vectors) - width + 1)
            )
            z += max(best + float(model.bias[f]), 0) * float(model.out[f])
        assert math.isclose(model.logit(known.text(" ".join(t).encode())), z, rel_tol=1e-4, abs_tol=1e-4)


def test_sample_passes_over_long_texts(spark):
    docs = spark.createDataFrame([(i, "x" * (500 if i % 3 == 0 else 20), "en") for i in range(60)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    free = docs.filter(~toxicity.held_out()).filter("doc_id % 3 != 0").count()
    assert toxicity.labelled_sample(docs, labels, longest=100).count() == free
    assert toxicity.labelled_sample(docs, labels, size=100, longest=100).count() == 5


def plain_kneser_ney(texts, order):
    """Probabilities by dictionaries, straight from the definition."""
    grams, vocabulary = Counter(), {None}
    for t in texts:
        tokens = [*t.lower().split(), None]
        vocabulary |= set(tokens)
        padded = ["<s>"] * (order - 1) + tokens
        grams.update(tuple(padded[i : i + order]) for i in range(len(tokens)))
    counts = {order: grams}
    for level in range(order - 1, 0, -1):
        counts[level] = Counter(g[1:] for g in counts[level + 1])
    d = {
        level: language_model.discounts([sum(c == k for c in own.values()) for k in (1, 2, 3, 4)])
        for level, own in counts.items()
    }
    after = {level: defaultdict(list) for level in counts}
    for level, own in counts.items():
        for g, c in own.items():
            after[level][g[:-1]].append(c)

    def probability(gram):
        level = len(gram)
        if not level:
            return 1 / (len(vocabulary) + 1)
        own = after[level].get(gram[:-1])
        if own is None:
            return probability(gram[1:])
        c = counts[level][gram]
        spare = sum(d[level][min(o, 3)] for o in own)
        return (max(c - d[level][min(c, 3)], 0) + spare * probability(gram[1:])) / sum(own)

    return probability, vocabulary


def test_gram_counts_of_any_size(tmp_path):
    """A count beyond a byte or 32 bits is stored and read whole, next to small ones, and so are its contexts."""
    numbers = [np.array([0, 0, 1 << 40], np.int64), np.array([3, 5, 9], np.int64)]
    for counts in ([1, 7, 2], [1, 255, 254], [1, 5_000_000_000, 2]):
        words = language_model.Words(str(tmp_path), 1, np.array([1 << 41]), 20)
        data = pack(numbers[0], np.array(counts, np.int64), numbers[1])
        rows = pd.DataFrame({"kind": ["gram"], "bucket": [0], "data": [data]})
        sent = pa.Table.from_batches(list(language_model._gram_part(rows, words, 2, 2))).to_pandas()
        language_model._write_contexts(sent, words, 0, 2)
        model = language_model.KneserNey(words, {2: np.zeros(4)}, np.zeros(4), 0, np.zeros(3))
        asked = language_model._hashed([np.array([0, 0, 0, 1 << 40]), np.array([5, 3, 4, 9])])
        order = np.argsort(asked)
        got = np.empty(4, np.int64)
        got[order] = model._stored("grams2", "gram_counts2", asked[order])[:, 0]
        assert got.tolist() == [counts[1], counts[0], 0, counts[2]]
        context = language_model._hashed([np.array([0])])
        assert model._stored("contexts2", "context_sums2", context, 4)[0, 0] == counts[0] + counts[1]


def test_discounts_leave_something_to_unseen_words():
    for n in itertools.product([0, 1, 3, 20], repeat=4):
        d = language_model.discounts(n)
        assert d[0] == 0 and all(0 < d[k] <= k for k in (1, 2, 3))


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, order):
    docs = texts_of(spark, SMALL, 60) + [(900, b""), (901, b"never seen words")]
    train = [t for _, t in docs[:40]]
    df = spark.createDataFrame([(t,) for t in train], "text binary")
    model = language_model.train(df, bucket_bytes=10_000 * order, order=order)
    assert model.words.buckets > 3
    probability, vocabulary = plain_kneser_ney(train, order)
    context = tuple(train[0].lower().split()[: order - 1])
    assert sum(probability((*context, v)) for v in [*vocabulary, b"unseen"]) == pytest.approx(1)
    counts = Counter(w for t in train for w in [*t.lower().split(), None])
    got = model.score([t for _, t in docs])
    for i, (_, t) in enumerate(docs):
        tokens = [*t.lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in tokens)
        padded = ["<s>"] * (order - 1) + tokens
        score = sum(math.log10(probability(tuple(padded[i : i + order]))) for i in range(len(tokens)))
        row = got.iloc[i]
        assert (row["n_tokens"], row["n_known"]) == (len(tokens), sum(counts[w] > 0 for w in tokens))
        assert (row["base_score"], row["score"]) == pytest.approx((base, score))


def plain_starts(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]


def test_induced_sorting(monkeypatch):
    rnd = random.Random(1)
    for round_ in range(300):
        size, length = rnd.choice([1, 2, 3, 8, 200]), rnd.choice([1, 2, 3, 5, 9, 17])
        texts = [bytes(rnd.randrange(size) for _ in range(rnd.choice([0, 1, 5, 30, 80]))) for _ in range(rnd.choice([1, 2, 5, 9]))]
        texts += [t[3:] + b"\1" for t in texts if round_ % 2]
        monkeypatch.setattr(induced_sort, "MOST_NAMES", 4096 if round_ % 3 else 0)
        monkeypatch.setattr(induced_sort.Queues.__init__, "__defaults__", (200 if round_ % 5 else 1 << 20,))
        assert [list(s) for s in induced_sort.repeated_starts(texts, length)] == plain_starts(texts, length)


def cut_plainly(texts, length):
    out = []
    for t, starts in zip(texts, plain_starts(texts, length), strict=True):
        gone = {i + k for i in starts for k in range(length)}
        spans = sum(i in gone and i - 1 not in gone for i in range(len(t)))
        out.append((len(t), len(gone), spans, bytes(b for i, b in enumerate(t) if i not in gone)))
    return out


def test_suffix_dedup(spark, monkeypatch):
    rnd = random.Random(4)
    parts = ["".join(rnd.choice("ab é") for _ in range(n)) for n in (30, 45, 60, 90)]
    texts = ["".join(rnd.choice(parts)[rnd.randrange(9) :] for _ in range(rnd.choice([0, 1, 3]))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 500)
    got = suffix_dedup.dedup_substrings(docs, 40).orderBy("doc_id").collect()
    found = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got]
    assert found == cut_plainly([t.encode() for t in texts], 40)


def test_suffix_dedup_of_a_passage_in_many_surroundings(spark, monkeypatch):
    rnd = random.Random(6)

    def noise(n):
        return "".join(rnd.choice("abcdefgh ") for _ in range(n))

    texts, whole = [], []
    for size, n in ((200, 120), (330, 40), (520, 40)):
        passage, sides = noise(size), [noise(300) for _ in range(n)]
        texts += [noise(300) + passage + s for s in sides]
        texts += [noise(300 - k) + noise(k) + passage + sides[k % n][: 60 + 9 * k] + noise(250) for k in range(12)]
        whole += texts[-2:]
    texts += whole
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 6000)
    dealt, inner = [], suffix_dedup._shards
    monkeypatch.setattr(suffix_dedup, "_shards", lambda *a: dealt.append(inner(*a)) or dealt[-1])
    got = suffix_dedup.dedup_substrings(docs).orderBy("doc_id").collect()
    found = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got]
    assert found == cut_plainly([t.encode() for t in texts], 400)
    sizes = dealt[0][0].groupBy("shard").agg(F.sum(F.octet_length("text") * F.least("n", F.lit(2))))
    assert max(r[1] for r in sizes.collect()) < 4 * 6000


def test_suffix_dedup_of_documents(spark):
    docs = texts_of(spark, SMALL)
    got = {r["doc_id"]: r for r in queries.op2_suffix_dedup(spark, SMALL).collect()}
    for (d, _), (n, gone, spans, kept) in zip(docs, cut_plainly([t for _, t in docs], 400), strict=True):
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, gone, spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_of_passages_of_over_50_words(spark):
    # What repeats goes from 400 bytes on, however many words that are.
    rnd = random.Random(9)

    def words(n_bytes):
        return "".join(rnd.choice("abcdefgh" if k % 7 else " ") for k in range(1, n_bytes + 1))

    texts, held = [words(900) for _ in range(9)], {}
    for n_bytes in (394, 399, 400, 460):
        passage = words(n_bytes)
        assert len(passage.split()) > 50
        held |= {len(texts) + k: n_bytes for k in range(3)}
        texts += [f"{words(300)}{k}{passage}{k}{words(300)}" for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup_digest(docs).collect()}
    for i, (n, gone, spans, kept) in enumerate(cut_plainly([t.encode() for t in texts], 400)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (n, gone, spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert gone == (held[i] if held.get(i, 0) >= 400 else 0)


def test_line_dedup_on_few_different_lines(spark):
    rnd = random.Random(8)
    texts = ["\n".join(rnd.choice(["", "a", "b", "c", "d"]) for _ in range(rnd.choice([1, 2, 3, 9, 20]))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    seen = set()
    for i, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if window in seen else set()
            seen.add(window)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        assert (got[i]["kept_text"], got[i]["n_lines"], got[i]["n_removed"]) == (kept, len(lines), len(gone))


def test_embeddings_over_many_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 8))[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.12
    x[5], x[6], x[7], x[9] = x[4], x[4] * 2, 0, np.nan
    labels = [int(v) for v in rng.integers(0, 2, 300)]
    labels[4:7] = [1, 1, 1]
    rows = [(i, [float(v) for v in x[i]], None if i == 20 else labels[i]) for i in range(300)]
    rows += [(300, None, 1), (301, [], 1), (302, [None, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    usable = [i for i in range(300) if i not in (7, 9, 20)]
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    links = [(i, j) for i in usable for j in usable if i > j and labels[i] == labels[j] and unit[i] @ unit[j] >= 0.93]
    roots, degree = roots_of(303, links), Counter(v for pair in links for v in pair)
    classes = embedding_dedup.vector_classes(df)
    small = embedding_dedup.vector_links(classes, block=16).groupBy("cid").agg(F.sum("n").alias("links"))
    by_class = {r["first"]: r["links"] for r in classes.join(small, "cid").collect()}
    assert all(n == degree[v] - (v == 4) for v, n in by_class.items() if v not in (4, 5)) and by_class
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup_embeddings(df).collect()}
    assert got == {i: (degree[i], roots[i], roots[i] == i) for i in range(303)}


@pytest.mark.parametrize("dim", [3, 24, 64])
def test_linked_vectors(dim):
    rng = np.random.default_rng(dim)
    centers = rng.normal(size=(40, dim)) * np.linspace(3, 0.3, dim)
    x = centers[np.sort(rng.integers(0, 40, 700))] + rng.normal(size=(700, dim)) * 0.2
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    axes = np.linalg.eigh(np.cov(unit.T))[1][:, ::-1][:, : min(dim, embedding_dedup.BOUNDS)]
    # In grid order, as the blocks are; any order gives the same links.
    order = np.lexsort(np.floor(unit @ axes[:, :4] / 0.1).T[::-1])
    x, unit = x[order], unit[order]
    linked, first, full = embedding_dedup.linked_vectors(x[:400], x[300:], axes)
    assert (linked == (unit[:400] @ unit[300:].T >= 0.93)).all()
    assert linked.sum() <= full <= first <= 400 * 400
    assert dim < 24 or (first < 0.8 * 400 * 400 and full < 0.3 * 400 * 400)


def test_blocks_farther_apart_than_eps_do_not_meet(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(64, 12))
    x = np.concatenate([c + rng.normal(size=(8, 12)) * 0.05 for c in centers])
    df = spark.createDataFrame(
        [(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>, label int"
    )
    classes = embedding_dedup.vector_classes(df)
    held = spark.sparkContext.broadcast(embedding_dedup.principal_axes(classes))
    blocks = embedding_dedup.grid_blocks(classes, held, block=8)
    numbered = blocks.withColumn("no", F.row_number().over(Window.orderBy("part", "seq")) - F.lit(1)).cache()
    n = numbered.count()
    pairs = {(r["a"], r["b"]) for r in embedding_dedup.block_pairs(numbered.withColumn("no", F.col("no").cast("bigint"))).collect()}
    assert len(pairs) < 0.5 * n * (n + 1) / 2
    held_by = {r["no"]: (np.frombuffer(r["vectors"]).reshape(-1, 12)) for r in numbered.collect()}
    unit = {k: v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for k, v in held_by.items()}
    must = {(a, b) for a in unit for b in unit if a <= b and (unit[a] @ unit[b].T >= 0.93).any()}
    assert must <= pairs
    numbered.unpersist()


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "sharding":
            assert docs.columns == before.columns
    everything = texts_of(spark, SMALL)
    scored = toxicity.score_toxicity(
        spark.read.parquet(f"{SMALL}/documents.parquet"),
        toxicity.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")),
    )
    assert sorted(kept["toxicity"]) == sorted(r["doc_id"] for r in scored.filter("NOT rejected").collect())
    left = [(d, t) for d, t in everything if d in set(kept["toxicity"])]
    prints = [plain_fingerprint(t) for _, t in left]
    links = [(i, j) for i in range(len(left)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = roots_of(len(left), links)
    assert sorted(kept["near_duplicates"]) == [left[i][0] for i in range(len(left)) if roots[i] == i]
    bench = [decontamination.words_of((r["text"] or "").encode()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in bench if len(w) >= 10 for i in range(len(w) - 9)} | {tuple(w) for w in bench if 0 < len(w) < 10}
    sizes = {len(w) for w in windows}
    text_of = dict(everything)

    def clean(d):
        w = decontamination.words_of(text_of[d])
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(kept["decontamination"]) == [d for d in sorted(kept["near_duplicates"]) if clean(d)]
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(Counter(kept["mixing"]).values()) <= 3
    assert sorted(kept["sharding"]) == sorted(kept["mixing"])
