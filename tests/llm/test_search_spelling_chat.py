"""Lexical search, spelling groups and chat formatting against plain Python versions."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import chat, lexical_search, spelling

BLANK = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- ranked lexical search


def plain_terms(text):
    kept = "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else "\0" for c in (text or "").translate(BLANK))
    return [t for t in kept.split("\0") if t]


def plain_search(docs, items, k):
    bags = [Counter(plain_terms(t)) for _, t in docs]
    total = sum(1 for b in bags if b)
    length = sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    found = {}
    for item in dict.fromkeys(i for i, _ in items):
        terms = {t for i, text in items if i == item for t in plain_terms(text)}
        scored = []
        for (doc, _), bag in zip(docs, bags, strict=True):
            m = 100 - 50 + 50 * sum(bag.values()) * total // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in terms
                if t in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        found[item] = [(None if none else d, -s) for s, none, d in sorted(scored)[:k]]
    return found


def some_texts(seed, n):
    rnd = random.Random(seed)
    words = ["été", "The", "of", "x1", "größe", "\U0001f600"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rnd.choices(words, weights, k=rnd.choice([0, 1, 3, 20, 200]))) for _ in range(n)]
    return texts + [texts[3]] * 40 + [None, "", "--"]


@pytest.mark.parametrize("k,postings,pairs", [(5, 100, 10**6), (50, 10**9, 7)])
def test_search_against_all_scores(spark, k, postings, pairs):
    texts = some_texts(1, 300)
    docs = [(None if i == 9 else i % 330, t) for i, t in enumerate(texts)]
    items = [(i, t) for i, t in enumerate(some_texts(2, 25)[:25])] + [(3, "w1 x1 W2"), (None, "the w3"), (99, "unseen")]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    index = lexical_search.build_index(rows, segment_postings=postings)
    assert index.filter("term IS NULL").agg(F.sum(F.size("ids"))).first()[0] == len(docs)
    assert index.select("segment").distinct().count() >= (10 if postings == 100 else 3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = lexical_search.search(index, asked, k, block_pairs=pairs).orderBy("item", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["item"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(found[r["item"]])
    assert found == {i: rows for i, rows in plain_search(docs, items, k).items() if rows}


def test_range_maxima():
    rng = np.random.default_rng(4)
    lists = [np.sort(rng.choice(900, n, replace=False)) for n in (1, 2, 300, 7, 64)]
    impacts = [rng.integers(1, 9, len(one)) for one in lists]
    segment = lexical_search.Segment(lists, impacts)
    flat = np.concatenate(impacts)
    for begin, end in zip(segment.begins, segment.ends, strict=True):
        for _ in range(50):
            a, b = sorted(rng.integers(begin, end + 1, 2))
            got = segment.maxima(np.array([a]), np.array([b]))[0]
            assert got == (a + flat[a:b].argmax() if b > a else -1)


def test_search_skips_documents():
    """Intervals that cannot hold a best document are dropped, so few documents are scored."""
    rng = np.random.default_rng(5)
    lists = [np.arange(20_000), np.sort(rng.choice(20_000, 60, replace=False))]
    segment = lexical_search.Segment(lists, [rng.integers(1, 100, 20_000), np.full(60, 10_000)])
    seen = []
    bounds = segment._bounds
    segment._bounds = lambda a, b: seen.append(len(a)) or bounds(a, b)
    assert len(segment.best(np.array([0, 1]), 20_000, 50)) == 50 and sum(seen) < 1_000


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical_search.lexical_digest(docs, asked).collect() == []
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    assert lexical_search.lexical_digest(some, asked.limit(0)).collect() == []
    wide = some.select("*", *[F.lit("x").alias(c) for c in ("term", "segment", "docs", "score", "rank", "item")])
    assert [tuple(r)[:3] for r in lexical_search.lexical_digest(wide, asked).collect()] == [(1, 1, 1)]


def test_norms_of_long_documents_do_not_wrap():
    got = lexical_search.length_norms(np.array([10**8, 1]), 5 * 10**10, 10**13)
    assert got.tolist() == [50 + 50 * 10**8 * 5 * 10**10 // 10**13, 50]


# ---- spelling variants


def plain_words(docs):
    counts = Counter()
    for doc, text in docs:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            run = run.translate(BLANK)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if run and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words):
    out, form = {}, {}
    for w, n in words.items():
        near = sorted((-words[v], v) for v in words if one_edit(w, v))
        if near and -near[0][0] >= 2 * n:
            form[w] = near[0][1]
        out[w] = [n, len(near)]
    rows = set()
    for w, (n, n_near) in out.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, n_near, words[form[w]] if w in form else None))
    return rows


def group_rows(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_of_documents(spark):
    rnd = random.Random(6)
    stems = ["".join(rnd.choices("abcdeéü", k=rnd.choice([4, 5, 6, 9]))) for _ in range(25)]
    docs = [(i, "-".join(rnd.choices(stems, k=150)).title()) for i in range(200)]
    docs += [(None, "Straße straße STRAßE Āstraße"), (7, None), (8, ""), (9, "\U0001f600été÷×été")] * 2
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    words = plain_words(docs)
    assert {(r["word"], r["n"]) for r in spelling.count_words(rows).collect()} == set(words.items())
    assert group_rows(spelling.spelling_digest(rows)) == plain_groups(words)
    assert spelling.spelling_digest(rows.limit(0)).collect() == []


@pytest.mark.parametrize("cell,piece", [(30, 10_000), (30, 9), (10_000, 50)])
def test_near_words_over_cells_and_pieces(spark, cell, piece):
    rnd = random.Random(7)
    words = {}
    for _ in range(60):
        w = "".join(rnd.choices("abcÿ", k=rnd.choice([5, 6, 7])))
        for _ in range(rnd.choice([1, 6])):
            words[w] = rnd.randrange(3, 50)
            at = rnd.randrange(len(w))
            w = w[:at] + rnd.choice(["", "x", w[at] + "a"]) + w[at + 1 :]
            w = w if len(w) >= 5 else w + "zz"
    words["a" * 300], words["a" * 301], words["a" * 299 + "b"] = 3, 9, 4
    table = spelling.cut(spark.createDataFrame(list(words.items()), "word string, n bigint"))
    got = {r["word"]: (r["n_near"], -r["best"]["minus_n"], r["best"]["word"]) for r in spelling.near_words(table, cell, piece).collect()}
    want = {}
    for w in words:
        near = sorted((-words[v], v) for v in words if one_edit(w, v))
        if near:
            want[w] = (len(near), -near[0][0], near[0][1])
    assert got == want and want
    if piece > 50:
        assert group_rows(spelling.variant_groups(table)) == plain_groups(words)


def test_tree_visits_every_box_within_reach():
    rnd = random.Random(8)
    words = [bytes(rnd.choices(b"abcd", k=8)) for _ in range(400)]
    points = spelling.letter_counts(words)
    tree = spelling.KdTree(points, 5)
    assert sorted(i for own in tree.leaves for i in own) == list(range(400))
    met = {(int(q), int(i)) for leaf, own in tree.visits(points, 1, 1) for q in own for i in tree.leaves[leaf]}
    apart = points[:, None, :].astype(int) - points[None, :, :]
    near = (np.maximum(apart, 0).sum(axis=2) <= 1) & (np.maximum(-apart, 0).sum(axis=2) <= 1)
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)) <= met
    assert len(met) < 400 * 400 / 2
    marks = spelling.signatures(points)
    assert (np.bitwise_count(marks[:, None] ^ marks[None, :]) <= np.abs(apart).sum(axis=2)).all()


def test_forms_lead_through_long_chains(spark):
    links = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {w: "w040" for w, _ in links}


# ---- chat formatting


def tree_rows(spark, rows):
    return spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")


def plain_branches(rows, branches):
    trees = {}
    for tree, node, parent, _, _, score in rows:
        trees.setdefault(tree, {})[node] = (parent, score or 0.0)
    found = {}
    for tree, nodes in trees.items():
        answered = {p for p, _ in nodes.values() if p in nodes}
        ranked = []
        for leaf in nodes.keys() - answered:
            path = [leaf]
            while nodes[path[-1]][0] in nodes and len(path) <= len(nodes):
                path.append(nodes[path[-1]][0])
            if len(path) <= len(nodes):
                ranked.append((-sum(nodes[n][1] for n in path), -len(path), leaf, path[::-1]))
        found[tree] = [r[3] for r in sorted(ranked)[:branches]]
    return {t: paths for t, paths in found.items() if paths}


@pytest.mark.parametrize("branches", [1, 3])
def test_branches_of_reply_trees(spark, branches):
    rnd = random.Random(10)
    rows = []
    for tree in (0, 1, 2, None):
        for node in range(rnd.choice([1, 2, 40])):
            parent = None if node == 0 else rnd.randrange(max(0, node - 4), node)
            rows.append((tree, node, parent, "user", f"{tree}/{node}", rnd.choice([None, 0.5, 1.0, -2.0])))
    rows += [(5, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(133)]
    rows += [(6, 1, 77, "user", "parent missing", 0.0), (7, 1, 2, "a", "circle", 0.0), (7, 2, 1, "b", "circle", 0.0)]
    rows += [(8, 1, None, "a", "", 1.0), (8, 2, 3, "a", "circle", 1.0), (8, 3, 2, "a", "circle", 1.0)]
    got = {}
    paths = chat.branch_paths(tree_rows(spark, rows), branches).orderBy("tree", "branch", "step").collect()
    for r in paths:
        path = got.setdefault(r["tree"], {}).setdefault(r["branch"], [])
        path.append(r["node"])
        assert r["step"] == len(path)
    assert {t: [p[b] for b in sorted(p)] for t, p in got.items()} == plain_branches(rows, branches)


PARTS = [
    "\\", "<", "|", "im_end", "<|im_end|>", "<|im_start|>", "<|im_sep|>", "</s>", "[INST]", "[/INST]",
    "<<SYS>>", "s>", "\n", "é", "\U0001f600", "a", "\0", "$1", "\\\\",
]


def test_texts_come_back_and_hold_no_control_strings(spark):
    rnd = random.Random(11)
    rows, said = [], {}
    for tree in range(150):
        for node in range(rnd.choice([1, 2, 5])):
            text = rnd.choice([None, "", *["".join(rnd.choices(PARTS, k=rnd.randrange(9)))] * 8])
            role = rnd.choice(["user", "assistant", "assistant", None, "<|im_sep|>\\"])
            rows.append((tree, node, node - 1 if node else None, role, text, None))
            said.setdefault(tree, []).append((role or "", text or ""))
    rows.append((900, 0, None, "assistant", "long " * 200_000, None))
    said[900] = [("assistant", "long " * 200_000)]
    template = chat.Template()
    extra = tree_rows(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("leaf", "branch", "formatted", "_tree", "_node", "_to")])
    done = chat.format_trees(extra)
    for r in done.collect():
        turns = template.turns(r["formatted"])
        assert turns == said[r["tree"]] and r["n_turns"] == len(turns)
        assert template.masked(r["formatted"], r["loss"]) == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"].count("<|im_end|>") == len(turns)
        assert not any(m in r["formatted"] for m in template.foreign)
    assert done.count() == len(said)
    assert chat.format_trees(extra.limit(0)).collect() == []
    with pytest.raises(ValueError):
        chat.Template(close="aba")
    with pytest.raises(ValueError):
        chat.Template(middle="|>x", close="<|im_end|>")


def test_conversations_with_ties_and_without_id(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "first"), (None, 3, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("tree", F.lit(4))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.chat_digest(df).collect()}
    assert got == {1: (4, 0), None: (1, 0), -7: (2, 21)}
    assert {r["conv_id"] for r in chat.chat_digest(df.limit(0)).collect()} == {-7}
