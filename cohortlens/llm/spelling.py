"""Spelling variant grouping: k-d trees over letter counts find words one edit apart.

A replaced letter takes one letter's count down by one and another's up by one, an
inserted letter takes one count up. So the words one edit from a word lie in a small
box around its letter counts, among the words of its own length or of one letter more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, id_text, is_small, text_bytes

#: Least code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One (document, run) in so many loses a letter.
HARMED = 97
#: Distinct words that a task holds before it hands its counts out.
HELD_WORDS = 500_000
#: Words whose letter counts shape the upper tree, and their greatest length.
SAMPLE_WORDS, SAMPLE_LENGTH = 100_000, 64
#: Words that a cell of the upper tree is meant to hold, and the most of a piece.
CELL_WORDS, PIECE_WORDS, PIECE_SEEKERS = 20_000, 60_000, 240_000
#: Words of a leaf of the tree within a cell.
LEAF_WORDS = 24
#: Words whose letters are counted at a time.
COUNTED = 20_000
#: Candidate pairs compared at a time.
PAIRS = 2_000_000

#: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
_RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of texts without letters beyond U+00FF; there each byte tells whether it is in a run.
_PLAIN = bytes([*range(128), 0xC3, *range(0x80, 0xC0)])
_BLANKED = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in _LOWER)
_CODES = np.zeros(256, np.int64)
_CODES[97:123] = np.arange(26)
_CODES[192:256] = np.arange(26, LETTERS)
_ROUTED = "length int, leaf int, kind int, word string, n bigint"
_NEAR = "word string, n_near bigint, best_n bigint, best string"
_OWN, _SAME, _SHORTER = 0, 1, 2


def runs_of(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lower-cased, as UTF-8."""
    if not text.translate(None, _PLAIN):
        return text.translate(_BLANKED).split()
    return _RUN.findall(text.translate(_LOWER))


def harmed(run: bytes, h: int) -> bytes:
    """``run`` without one letter, if ``h`` says so."""
    if h % HARMED:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = [w.decode() for w in held]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )
        held.clear()
        return batch

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            prefix = zlib.crc32(f"{key}:".encode())
            for run, n in Counter(runs_of(text)).items():
                word = harmed(run, zlib.crc32(run, prefix))
                if len(word) >= LEAST_LENGTH:
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield out()
    yield out()


def count_words(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(word, n): words of at least 5 code points that occur 3 times or more in all ``docs``.

    Counts are added up in each task before the shuffle. NULL and empty texts have
    no words; a NULL key counts as an empty one; equal rows count each.
    """
    rows = docs.select(id_text(key).alias("key"), text_bytes("text").alias("text"))
    return (
        rows.mapInArrow(_count_batches, "word string, n bigint")
        .filter(F.char_length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= LEAST_COUNT)
    )


def letter_counts(words: list[bytes]) -> np.ndarray:
    """One row of letter counts for each word (Latin-1)."""
    out = np.zeros((len(words), LETTERS), np.int16)
    for at in range(0, len(words), COUNTED):
        some = words[at : at + COUNTED]
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        codes = _CODES[np.frombuffer(b"".join(some), np.uint8)]
        cells = np.repeat(np.arange(len(some)) * LETTERS, sizes) + codes
        flat = np.bincount(cells, minlength=len(some) * LETTERS)
        out[at : at + len(some)] = np.minimum(flat, 32_000).reshape(len(some), LETTERS)
    return out


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits of which one more or one less letter changes one at most.

    Two bits for each of a-z (met, met twice), and 12 parities of the other letters.
    """
    bits = [counts[:, :26] >= 1, counts[:, :26] >= 2]
    other = counts[:, 26:]
    bits.append(np.stack([other[:, i::12].sum(axis=1) % 2 == 1 for i in range(12)], axis=1))
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return (np.concatenate(bits, axis=1).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)


class KdTree:
    """Splits points by one letter's count at a time, where that halves them best."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.letter: list[int] = []
        self.value: list[int] = []
        self.kids: list[list[int]] = []
        self.leaves: list[np.ndarray] = []
        waiting = [(np.arange(len(points)), -1, 0)]
        while waiting:
            own, parent, side = waiting.pop()
            found = self._halves(points[own]) if len(own) > leaf else None
            if found is None:
                name = ~len(self.leaves)
                self.leaves.append(own)
            else:
                name = len(self.letter)
                letter, value = found
                self.letter.append(letter)
                self.value.append(value)
                self.kids.append([0, 0])
                low = points[own, letter] <= value
                waiting += [(own[low], name, 0), (own[~low], name, 1)]
            if parent >= 0:
                self.kids[parent][side] = name
        self.root = 0 if self.letter else ~0

    @staticmethod
    def _halves(points: np.ndarray) -> tuple[int, int] | None:
        """Letter and count that split best; None if all points are equal."""
        n = len(points)
        middle = np.partition(points, n // 2, axis=0)[n // 2]
        best, found = 0, None
        for value in (middle, middle - 1):
            low = (points <= value).sum(axis=0)
            spread = np.minimum(low, n - low)
            letter = int(spread.argmax())
            if spread[letter] > best:
                best, found = int(spread[letter]), (letter, int(value[letter]))
        return found

    def visits(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, numbers of points) wherever a leaf's box is near a point.

        Near: raising letter counts by at most ``up`` in all, and lowering them by at
        most ``down``, leads into the box.
        """
        zero = np.zeros(len(points), np.int32)
        waiting = [(self.root, np.arange(len(points)), zero, zero, {}, {})]
        while waiting:
            node, own, ups, downs, least, most = waiting.pop()
            if not len(own):
                continue
            if node < 0:
                yield ~node, own
                continue
            letter, value = self.letter[node], self.value[node]
            x = points[own, letter].astype(np.int32)
            lower = downs + np.maximum(x - value, 0)
            if letter in most:
                lower -= np.maximum(x - most[letter], 0)
            higher = ups + np.maximum(value + 1 - x, 0)
            if letter in least:
                higher -= np.maximum(least[letter] - x, 0)
            a, b = lower <= down, higher <= up
            low, high = self.kids[node]
            waiting.append((low, own[a], ups[a], lower[a], least, most | {letter: value}))
            waiting.append((high, own[b], higher[b], downs[b], least | {letter: value + 1}, most))


def _letters(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``b`` is that of ``a`` with one letter more."""
    ones = np.ones((len(a), 1), bool)
    front = np.hstack([ones, np.logical_and.accumulate(a == b[:, :-1], axis=1)])
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1)[:, ::-1]
    return (front & np.hstack([back, ones])).any(axis=1)


def near_pairs(own: list[bytes], seekers: list[bytes], length: int, shorter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (seeker, own word) of the pairs one edit apart.

    ``own`` have ``length`` letters, ``seekers`` as many, or one less if ``shorter``.
    """
    if not own or not seekers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points, seeking = letter_counts(own), letter_counts(seekers)
    marks, sought = signatures(points), signatures(seeking)
    letters, sought_letters = _letters(own, length), _letters(seekers, length - shorter)
    verify, differ = (one_inserted, 1) if shorter else (one_replaced, 2)
    tree = KdTree(points, LEAF_WORDS)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for leaf, near in tree.visits(seeking, 1, 0 if shorter else 1):
        members = tree.leaves[leaf]
        for m in range(0, len(members), 1000):
            some = members[m : m + 1000]
            step = max(1, PAIRS // len(some))
            for at in range(0, len(near), step):
                who = near[at : at + step]
                apart = np.bitwise_count(sought[who, None] ^ marks[some][None, :])
                i, j = np.nonzero(apart <= differ)
                found.append((who[i], some[j]))
    a = np.concatenate([f[0] for f in found])
    b = np.concatenate([f[1] for f in found])
    step, good = max(1, 20_000_000 // length), []
    for at in range(0, len(a), step):
        good.append(verify(sought_letters[a[at : at + step]], letters[b[at : at + step]]))
    kept = np.concatenate(good) if good else np.zeros(0, bool)
    return a[kept], b[kept]


def _best(words: np.ndarray, counts: np.ndarray, who: np.ndarray, near: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
    """Near words of each of ``who``: how many, and the one of least rank."""
    order = np.lexsort((rank[near], who))
    who, near = who[order], near[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    sizes = np.diff(np.append(first, len(who)))
    best = near[first]
    return pd.DataFrame(
        {"word": words[who[first]], "n_near": sizes, "best_n": counts[best], "best": words[best]}
    )


def search_cell(rows: pd.DataFrame) -> pd.DataFrame:
    """The near words that the words of one piece of a cell and its seekers give each other."""
    words, counts = rows["word"].to_numpy(object), rows["n"].to_numpy()
    kinds, length = rows["kind"].to_numpy(), int(rows["length"].iloc[0])
    plain = [w.encode("latin-1") for w in words]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))] = np.arange(len(words))
    own = np.flatnonzero(kinds == _OWN)
    out = []
    for kind in (_SAME, _SHORTER):
        seekers = np.flatnonzero(kinds == kind)
        a, b = near_pairs([plain[i] for i in own], [plain[i] for i in seekers], length, kind == _SHORTER)
        if len(a):
            a, b = seekers[a], own[b]
            out.append(_best(words, counts, a, b, rank))
            if kind == _SHORTER:
                out.append(_best(words, counts, b, a, rank))
    return pd.concat(out) if out else pd.DataFrame(columns=["word", "n_near", "best_n", "best"])


def upper_trees(words: DataFrame, total: int, cell_words: int) -> dict[int, KdTree]:
    """A tree for each length, grown from a sample of words drawn by hash.

    The share drawn makes about ``SAMPLE_WORDS`` words; they shape the cells only. Every
    word is placed in one.
    """
    share = F.lit(SAMPLE_WORDS / max(total, 1) * (1 << 30))
    drawn = (
        words.filter((F.char_length("word") <= SAMPLE_LENGTH) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share))
        .select("word")
        .collect()
    )
    by_length: dict[int, list[bytes]] = {}
    for r in drawn:
        by_length.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    leaf = max(1, len(drawn) * cell_words // max(total, 1))
    trees = {}
    for length, own in by_length.items():
        tree = KdTree(letter_counts(own), leaf)
        tree.leaves = [np.zeros(0, np.int64)] * len(tree.leaves)
        trees[length] = tree
    return trees


def _router(trees: Mapping[int, KdTree]):
    def places(length: int, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        if length in trees:
            yield from trees[length].visits(points, up, down)
        else:
            yield 0, np.arange(len(points))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            words, counts = rows["word"].to_numpy(object), rows["n"].to_numpy()
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                points = letter_counts([words[i].encode("latin-1") for i in own])
                for kind, at, up, down in ((_OWN, length, 0, 0), (_SAME, length, 1, 1), (_SHORTER, length + 1, 1, 0)):
                    for leaf, who in places(int(at), points, up, down):
                        yield pd.DataFrame(
                            {
                                "length": np.full(len(who), at, np.int32),
                                "leaf": np.full(len(who), leaf, np.int32),
                                "kind": np.full(len(who), kind, np.int32),
                                "word": words[own[who]],
                                "n": counts[own[who]],
                            }
                        )

    return route


def near_words(words: DataFrame, cell_words: int = CELL_WORDS, piece: int = PIECE_WORDS) -> DataFrame:
    """(word, n_near, best): near words of each word that has any, and the most frequent of them.

    ``words`` is a written table of distinct (word, n). The upper tree sends each word
    to its cell, and as a seeker to every cell that a word one edit away can lie in,
    so each pair meets in one cell, which a tree of its own searches. A cell with more
    than ``piece`` words, or more than four times as many seekers, is cut into pieces by
    hash, and each piece of words meets each piece of seekers.
    """
    trees = upper_trees(words, words.count(), cell_words)
    routed = cut(words.mapInPandas(_router(trees), _ROUTED), "spelling-routed")
    own = F.col("kind") == _OWN
    sizes = routed.groupBy("length", "leaf").agg(
        F.sum(F.when(own, 1).otherwise(0)).alias("_own"), F.sum(F.when(own, 0).otherwise(1)).alias("_seek")
    )
    seekers = piece * (PIECE_SEEKERS // PIECE_WORDS)
    large = cut(
        sizes.filter((F.col("_own") > piece) | (F.col("_seek") > seekers)).select(
            "length",
            "leaf",
            F.ceil(F.col("_own") / piece).cast("int").alias("_g"),
            F.ceil(F.col("_seek") / seekers).cast("int").alias("_h"),
        ),
        "spelling-large",
    )
    one = F.lit(1)
    g, h = F.greatest(F.coalesce("_g", one), one), F.greatest(F.coalesce("_h", one), one)
    mark = F.xxhash64("word")

    def each(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    def single(n: Column) -> Column:
        return F.array(F.pmod(mark, n).cast("int"))

    pieces = (
        routed.join(F.broadcast(large) if is_small(large) else large, ["length", "leaf"], "left")
        .withColumn("s", F.explode(F.when(own, single(g)).otherwise(each(g))))
        .withColumn("t", F.explode(F.when(own, each(h)).otherwise(single(h))))
        .drop("_g", "_h")
    )
    found = pieces.groupBy("length", "leaf", "s", "t").applyInPandas(search_cell, _NEAR)
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("word"))).alias("best"),
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` from each word of the table (word, form) ends.

    Each round joins the table to itself, which doubles the steps taken. Forms must
    not run in circles.
    """
    now = cut(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        after = cut(
            now.join(further, F.col("root") == F.col("_word"), "left").select(
                "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def variant_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of the table (word, n).

    A word's form is the most frequent of the words one edit away (ties: the smallest
    by code points), if that occurs at least ``ratio`` (2 or more) times as often. ``root``
    follows the forms to the last, and is the word itself where there is none. An
    empty table gives an empty one.
    """
    words = cut(words.select("word", "n"), "spelling-words")
    near = near_words(words)
    best = F.col("best")
    form_n = -best["minus_n"]
    good = form_n >= ratio * F.col("n")
    placed = cut(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(good, best["word"]).alias("form"),
            F.when(good, form_n).alias("form_n"),
        ),
        "spelling-forms",
    )
    last = roots(placed.filter("form IS NOT NULL"))
    return placed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_digest(docs: DataFrame) -> DataFrame:
    """The spelling groups of all words of the documents."""
    return variant_groups(count_words(docs)).select("word", "form", "root", "n", "n_near", "form_n")
