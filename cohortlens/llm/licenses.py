"""License scans: fuzzy search for short notices.

A notice with at most k edits, cut into k + 1 pieces, keeps one piece unharmed. So
exact finds of the pieces give all candidate places, and the bounded-error matching
of the ``regex`` library verifies them and counts the edits.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD_BYTES, packed, text_bytes

#: Phrases whose places are counted exactly, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices looked for with errors, in words, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the apache license": "apache",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons": "cc",
    "creative commons attribution": "cc",
    "licensed under cc by": "cc",
    "all rights reserved": "proprietary",
}
#: One edit for so many bytes of a notice.
BYTES_PER_EDIT = 12

_NOTICE = "struct<label:string,begin:int,end:int,edits:int,text:string>"
_FOUND = f"n_words bigint, places array<struct<label:string,word:int>>, notices array<{_NOTICE}>"


class Notice:
    """One notice with its seeds and its matcher."""

    def __init__(self, phrase: str, label: str, bytes_per_edit: int = BYTES_PER_EDIT) -> None:
        self.label, self.bytes = label, phrase.encode()
        self.edits = len(self.bytes) // bytes_per_edit
        size, parts = len(self.bytes), self.edits + 1
        ends = [size * (i + 1) // parts for i in range(parts)]
        self.seeds = [(a, self.bytes[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        self.match = regex.compile(
            b"(?b)(?:%b){e<=%d}" % (regex.escape(self.bytes, special_only=True), self.edits)
        )

    def windows(self, line: bytes) -> list[tuple[int, int]]:
        """Byte ranges in which an occurrence must lie, one for each seed found."""
        found = set()
        for offset, seed in self.seeds:
            at = line.find(seed)
            while at >= 0:
                begin = at - offset - self.edits
                found.add((max(0, begin), begin + len(self.bytes) + 2 * self.edits))
                at = line.find(seed, at + 1)
        return sorted(found)

    def occurrences(self, line: bytes) -> list[tuple[int, int, int]]:
        """(begin, end, edits) in bytes of the words joined by spaces, by rising place.

        Each window is too short for two occurrences, and is searched by itself; equal
        windows once. Of finds that share more than half a notice the one with the
        fewest edits stays, the first of equal ones.
        """
        known: dict[bytes, tuple[int, int, int] | None] = {}
        kept: list[tuple[int, int, int]] = []
        for begin, end in self.windows(line):
            window = line[begin:end]
            if window not in known:
                m = self.match.search(window)
                known[window] = (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None
            if known[window] is not None:
                a, b, edits = known[window]
                kept.append((begin + a, begin + b, edits))
        out: list[tuple[int, int, int]] = []
        for span in sorted(set(kept)):
            shared = min(span[1], out[-1][1]) - span[0] if out else 0
            if 2 * shared <= len(self.bytes):
                out.append(span)
            elif span[2] < out[-1][2]:
                out[-1] = span
        return out


def spaces_of(line: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(line, np.uint8) == 32)


def base_places(line: bytes, phrases: Mapping[str, str]) -> list[tuple[str, int]]:
    """(label, byte) of every place of a phrase; ``line`` has a space at either end."""
    found = []
    for phrase, label in phrases.items():
        at = line.find(b" %b " % phrase.encode())
        while at >= 0:
            found.append((label, at))
            at = line.find(b" %b " % phrase.encode(), at + 1)
    return found


def scan(
    text: bytes, phrases: Mapping[str, str], notices: Sequence[Notice]
) -> tuple[int, list[tuple[str, int]], list[dict]]:
    """Words, base places and notices of one text."""
    words = text.translate(WORD_BYTES).split()
    line = b" %b " % b" ".join(words)
    places = base_places(line, phrases)
    found = [(notice.label, *span) for notice in notices for span in notice.occurrences(line)]
    if not places and not found:
        return len(words), [], []
    spaces = spaces_of(line)

    def spaces_before(at: int) -> int:
        return int(np.searchsorted(spaces, at))

    spans = [
        {
            "label": label,
            "begin": max(0, spaces_before(begin + 1) - 1),
            "end": spaces_before(end - 1),
            "edits": edits,
            "text": line[begin:end].decode(errors="replace").strip(),
        }
        for label, begin, end, edits in found
    ]
    named = [(label, spaces_before(at)) for label, at in places]
    return len(words), named, sorted(spans, key=lambda s: (s["begin"], s["label"]))


def scan_licenses(
    docs: DataFrame,
    phrases: Mapping[str, str] = BASE,
    notices: Mapping[str, str] = NOTICES,
    bytes_per_edit: int = BYTES_PER_EDIT,
) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (label, word) and ``notices``.

    Texts are searched whole, as lower-case words joined by spaces. ``places`` are
    the exact places of ``phrases``, every one. ``notices`` lists each span within
    the edits allowed for its notice (one for ``bytes_per_edit`` bytes): label, first
    word, word after the last, edits and the words found. An edit is a byte. Finds that
    share more than half a notice are one. NULL and empty texts have no words, and a
    table without rows none either; equal rows are scanned each. The time grows with
    the length of a text and the seeds in it. Columns with the names of the results
    are replaced.
    """
    phrases, notices = dict(phrases), dict(notices)

    @F.pandas_udf(_FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = [Notice(p, label, bytes_per_edit) for p, label in notices.items()]
        for texts in batches:
            rows = []
            for text in texts:
                n, places, spans = scan(text, phrases, made)
                rows.append((n, [{"label": a, "word": b} for a, b in places], spans))
            yield pd.DataFrame(rows, columns=["n_words", "places", "notices"])

    rows = packed(docs.drop("n_words", "places", "notices"))
    return rows.withColumn("found", found(text_bytes("row.text"))).select("row.*", "found.*")


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: words, base places, labels, and how well the best notice fits."""
    sizes = {p.encode(): len(p.encode()) for p in NOTICES}
    shortest = float(min(sizes.values()))
    fit = F.transform("notices", lambda s: 1 - s["edits"] / F.greatest(F.octet_length(s["text"]), F.lit(shortest)))
    base = F.array_sort(F.array_distinct("places.label"))
    both = F.array_sort(F.array_distinct(F.concat("places.label", "notices.label")))
    return scan_licenses(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").cast("bigint").alias("first_word"),
        F.array_max("places.word").cast("bigint").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", both).alias("labels"),
        F.when(F.size("places") > 0, 1.0)
        .otherwise(F.greatest(F.lit(0.0), F.coalesce(F.array_max(fit), F.lit(0.0))))
        .alias("score"),
    )
