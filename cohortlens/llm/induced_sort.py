"""Suffix order and common prefixes of a shard of texts, by induced sorting with spilling queues.

The order of all suffixes follows from that of the LMS suffixes (those that start a
rise after a fall). A pass from the smallest character up derives the suffixes that
fall, a pass down those that rise: the queue of each character receives suffixes in
their order, with the common prefix that each has with the one before it in its
queue, one more than the smallest value passed since. The LMS suffixes are sorted by
the same method on the string of their substrings' names, or, where there are too
many names for a queue each, by doubling ranks in memory, which is the rule for texts.
Queues beyond a budget lie on disk; those of the shards of ``suffix_dedup`` stay below it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that queues may hold in memory.
QUEUE_BYTES = 96 << 20
#: Entries taken from a queue in one go.
MOST_TAKEN = 1 << 20
#: Most names of a reduced text that get a queue each.
MOST_NAMES = 4096
_FAR = np.int32(1 << 30)


class Queues:
    """A first-in-first-out queue of (position, common prefix) for each character."""

    def __init__(self, characters: int, budget: int = QUEUE_BYTES) -> None:
        self.lists: list[list] = [[] for _ in range(characters)]
        self.budget, self.held, self.file = budget, 0, None

    def push(self, character: int, positions: np.ndarray, common: np.ndarray) -> None:
        chunk = np.empty((2, len(positions)), np.int32)
        chunk[0], chunk[1] = positions, common
        self.lists[character].append(chunk)
        self.held += 8 * len(positions)
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for own in self.lists:
            for i, chunk in enumerate(own):
                if isinstance(chunk, np.ndarray):
                    own[i] = (self.file.tell(), chunk.shape)
                    self.file.write(chunk.tobytes())
        self.held = 0

    def chunks(self, character: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """Take a queue's entries, in batches of bounded size; it is empty afterwards."""
        own, self.lists[character] = self.lists[character], []
        batch, size = [], 0
        for chunk in reversed(own) if backwards else own:
            if isinstance(chunk, np.ndarray):
                self.held -= 4 * chunk.size
            else:
                self.file.seek(chunk[0])
                raw = self.file.read(4 * chunk[1][0] * chunk[1][1])
                chunk = np.frombuffer(raw, np.int32).reshape(chunk[1])
            batch.append(chunk)
            size += chunk.shape[1]
            if size >= MOST_TAKEN:
                yield np.concatenate(batch[::-1] if backwards else batch, axis=1)
                batch, size = [], 0
        if batch:
            yield np.concatenate(batch[::-1] if backwards else batch, axis=1)


class _Scan:
    """Hands the suffix before each passed one to its character's queue."""

    def __init__(self, text: np.ndarray, queues: Queues, characters: int) -> None:
        self.text, self.queues = text, queues
        self.since = np.full(characters, _FAR, np.int32)

    def passed(self, positions: np.ndarray, common: np.ndarray, character: int, way: str) -> None:
        """``way`` says which characters before lead to a suffix of the wanted kind."""
        before = self.text[positions - 1]
        if way == "up":
            wanted = before >= character
        elif way == "down":
            wanted = before <= character
        else:
            wanted = before < character
        own = np.flatnonzero(wanted & (positions > 0))
        if not len(own):
            np.minimum(self.since, common.min(), out=self.since)
            return
        targets = before[own]
        order = np.argsort(targets, kind="stable")
        own, targets = own[order], targets[order]
        begin = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
        found = targets[begin]
        open_ended = np.append(common, _FAR)
        others = np.ones(len(self.since), bool)
        others[found] = False
        np.minimum(self.since, common.min(), out=self.since, where=others)
        for target, a, b in zip(found, begin, [*begin[1:], len(own)], strict=True):
            at = own[a:b]
            least = np.minimum.reduceat(open_ended, np.concatenate([[0], at + 1]))
            least[0] = min(least[0], self.since[target])
            self.since[target] = least[-1]
            self.queues.push(int(target), positions[at] - 1, np.minimum(least[:-1], _FAR - 1) + 1)


def _run(text: np.ndarray, position: int, most: int) -> int:
    part = text[position : position + most]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induced(
    text: np.ndarray, characters: int, seeds: np.ndarray, common: np.ndarray, most: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest to the smallest, in batches, from the sorted LMS ones.

    With each suffix comes the common prefix with the next larger one; values are
    right up to ``most``. The end of the text counts as larger than any character.
    """
    falling, queues = Queues(characters), Queues(characters)
    scan = _Scan(text, queues, characters)
    ends = np.searchsorted(text[seeds], np.arange(characters + 1), side="left")
    for c in range(characters):
        last = -1
        while queues.lists[c]:
            for positions, lcp in queues.chunks(c):
                lcp = lcp.copy()
                if last < 0:
                    lcp[0] = 0
                falling.push(c, positions, lcp)
                scan.passed(positions, lcp, c, "up")
                last = int(positions[-1])
        own = slice(ends[c], ends[c + 1])
        if own.stop > own.start:
            lcp = common[own].astype(np.int32)
            lcp[0] = 0 if last < 0 else min(_run(text, last, most), _run(text, int(seeds[own][0]), most))
            scan.passed(seeds[own], lcp, c, "up")
    queues = Queues(characters)
    scan = _Scan(text, queues, characters)
    queues.push(int(text[-1]), np.array([len(text) - 1]), np.array([0]))
    for c in range(characters - 1, -1, -1):
        last = -1
        while queues.lists[c]:
            for positions, lcp in queues.chunks(c):
                lcp = lcp.copy()
                if last < 0:
                    lcp[0] = 0
                yield positions, lcp
                scan.passed(positions, lcp, c, "down")
                last = int(positions[-1])
        after = None
        for positions, lcp in falling.chunks(c, backwards=True):
            if after is None:
                first = int(positions[-1])
                after = 0 if last < 0 else min(_run(text, last, most), _run(text, first, most))
            positions, backwards = positions[::-1], np.append(after, lcp[::-1][:-1]).astype(np.int32)
            after = int(lcp[0])
            yield positions, backwards
            scan.passed(positions, backwards, c, "below")


def lms_positions(text: np.ndarray) -> np.ndarray:
    """Starts of runs of one character that rise, after a run that falls."""
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.append(text[change + 1] > text[change], True)
    starts = np.concatenate([[0], change + 1])
    return starts[1:][rises[1:] & ~rises[:-1]]


def _refined(rank: np.ndarray, own: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the entries ``own``, whole groups of equal ``rank``, told apart by ``key``;
    and which of them are still equal to another. A rank is the place of its group."""
    if key.dtype == np.int64:  # less than 2^31, as ranks are: both fit one number
        order = np.argsort((rank[own].astype(np.int64) << 32) | key)
    elif not rank.any():
        order = np.argsort(key)
    else:
        order = np.lexsort((key, rank[own]))
    entry, key = own[order], key[order]
    group = rank[entry]
    place = np.arange(len(entry))
    first = np.concatenate([[True], group[1:] != group[:-1]])
    begin = np.maximum.accumulate(np.where(first, place, 0))
    new = first | np.concatenate([[True], key[1:] != key[:-1]])
    at = np.maximum.accumulate(np.where(new, place, 0))
    out = rank.copy()
    out[entry] = group + (at - begin)
    more = np.zeros(len(rank), bool)
    more[entry[~(new & np.append(new[1:], True))]] = True
    return out, np.flatnonzero(more)


def _names(text: np.ndarray, lms: np.ndarray, most: int) -> np.ndarray:
    """Rank of each LMS substring (up to the next LMS character); equal ones share it.

    A substring that another one continues counts as larger, as the other falls there.
    """
    top = int(text.max()) + 1
    per_key = 8 if top < 256 else 4 if top < 1 << 15 else 1
    bits = np.uint64(64 // per_key) if per_key > 1 else np.uint64(0)
    pad = np.uint64(255 if per_key == 8 else (1 << 16) - 1 if per_key == 4 else top)
    size = np.append(np.diff(lms) + 1, 1)
    longer = np.concatenate([text, np.zeros(per_key, text.dtype)])
    rank, own = np.zeros(len(lms), np.int32), np.arange(len(lms))
    for offset in range(0, most + per_key, per_key):
        own = own[size[own] >= offset] if offset else own
        if not len(own):
            break
        key = np.zeros(len(own), np.uint64)
        for j in range(offset, offset + per_key):
            at = np.minimum(lms[own] + j, len(longer) - 1)
            key = (key << bits) | np.where(j < size[own], longer[at].astype(np.uint64), pad)
        rank, own = _refined(rank, own, key)
    return rank


def _doubled(names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``names`` up to ``depth``, and names shared with the one before."""
    n = len(names)
    levels, rank, step = [names], names, 1
    group = np.bincount(names, minlength=n)
    own = np.flatnonzero(group[names] > 1)
    while step < depth and len(own):
        key = np.where(own + step < n, rank[np.minimum(own + step, n - 1)], n).astype(np.int64)
        rank, own = _refined(rank, own, key)
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    i, j = order[1:].copy(), order[:-1].copy()
    shared = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((i < n) & (j < n))
        same = inside[levels[level][i[inside]] == levels[level][j[inside]]]
        for x in (i, j, shared):
            x[same] += 1 << level
    return order, np.append(0, shared)


def sorted_lms(text: np.ndarray, lms: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``lms`` in the order of their suffixes, and common prefixes up to ``most``.

    Suffixes equal for ``most`` characters may stand in any order.
    """
    names = _names(text, lms, most)
    distinct, dense = np.unique(names, return_inverse=True)
    if len(distinct) == len(lms):
        order, shared = np.argsort(names), np.zeros(len(lms), np.int64)
    elif len(distinct) <= MOST_NAMES and len(lms) > 64 * len(distinct):
        order, shared = suffixes(dense.astype(np.int32), len(distinct), most // 2 + 1)
    else:
        order, shared = _doubled(names, most // 2 + 1)
    n, m = len(text), len(lms)
    i, j = order[1:], order[:-1]
    reach = np.minimum(shared[1:], m - 1 - np.maximum(i, j))
    common = lms[i + reach] - lms[i]
    a, b = lms[i] + common, lms[j] + common
    open_pairs = np.flatnonzero(common < most)
    while len(open_pairs):
        x, y = a[open_pairs], b[open_pairs]
        inside = (x < n) & (y < n)
        same = inside & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
        open_pairs = open_pairs[same]
        for v in (a, b, common):
            v[open_pairs] += 1
        open_pairs = open_pairs[common[open_pairs] < most]
    return order, np.append(0, np.minimum(common, most))


def suffixes(text: np.ndarray, characters: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before, up to ``most``."""
    positions, common = [], []
    for p, lcp in descending(text, characters, most):
        positions.append(p)
        common.append(lcp)
    order, lcp = np.concatenate(positions)[::-1], np.concatenate(common)[::-1]
    return order.astype(np.int64), np.append(0, np.minimum(lcp[:-1], most)).astype(np.int64)


def descending(text: np.ndarray, characters: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lms = lms_positions(text)
    if len(lms):
        order, common = sorted_lms(text, lms, most)
        seeds = lms[order]
    else:
        seeds, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # The whole text rises: its last character is the largest suffix of all.
    yield from induced(text, characters, seeds, common, most)


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Starts in each text of the strings of ``length`` bytes that start elsewhere too.

    Texts are UTF-8, so the byte 0xFF is free to part them; nothing matches across.
    """
    joined = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8) + np.uint8(1)
    flagged = np.zeros(len(joined), bool)
    last = -1
    for positions, common in descending(joined, 256, length):
        hit = common >= length
        flagged[positions[hit]] = True
        flagged[np.concatenate([[last], positions[:-1]])[hit]] = True
        last = int(positions[-1])
    out, begin = [], 0
    for t in texts:
        end = begin + max(len(t) - length + 1, 0)
        out.append(np.flatnonzero(flagged[begin:end]))
        begin += len(t) + 1
    return out
