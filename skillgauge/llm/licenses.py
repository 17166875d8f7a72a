"""License scans: exact seeds by the pigeonhole rule, then bounded-error matching.

A short notice that may differ by up to k edits is cut into k + 1 pieces. With k
edits at most, one piece at least is unharmed, so plain searches for the pieces
find every candidate place. Around each candidate the `regex` library looks for
the notice with at most k errors and gives span and number of edits.

All searching is on a normal form of the text: ASCII letters in lower case, runs
of other ASCII characters than letters and digits as one space.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

# Phrases that count as they stand, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices by label, in normal form.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("unlicense", "released into the public domain"),
    ("proprietary", "all rights reserved no part of this"),
)
# One edit for so many characters of a notice.
CHARACTERS_PER_EDIT = 9

NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

SPAN = "array<struct<label:string,start:bigint,end:bigint,first_word:bigint,edits:int,similarity:double>>"
SCAN = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    f"score double, spans {SPAN}"
)


@dataclass(frozen=True)
class Notice:
    label: str
    text: bytes
    edits: int
    seeds: tuple[tuple[int, bytes], ...]
    pattern: object


def notice(label: str, text: str) -> Notice:
    """A notice with its edit bound, and its k + 1 pieces with their places."""
    raw = text.encode()
    edits = max(1, len(raw) // CHARACTERS_PER_EDIT)
    cuts = [round(i * len(raw) / (edits + 1)) for i in range(edits + 2)]
    seeds = tuple((a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    # Whole words: a match starts after a space and ends before one.
    pattern = regex.compile(rb"(?be)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(raw), edits))
    return Notice(label, raw, edits, seeds, pattern)


@functools.lru_cache(maxsize=1)
def notices() -> tuple[Notice, ...]:
    return tuple(notice(label, text) for label, text in NOTICES)


def places(text: bytes, part: bytes) -> list[int]:
    """Starts of all places of `part`, overlapping ones too."""
    found, at = [], text.find(part)
    while at >= 0:
        found.append(at)
        at = text.find(part, at + 1)
    return found


def candidates(text: bytes, one: Notice) -> list[tuple[int, int]]:
    """Ranges of `text` that hold every place where `one` can match: one for each piece found, so none is longer than a notice and its edits."""
    reach = set()
    for offset, seed in one.seeds:
        for at in places(text, seed):
            reach.add((max(0, at - offset - one.edits - 1), min(len(text), at - offset + len(one.text) + one.edits + 1)))
    return sorted(reach)


def best_matches(text: bytes, one: Notice, a: int, b: int) -> list[tuple[int, int, int]]:
    """Start, end and edits of all matches in text[a:b] that do not overlap.

    The pattern takes the best match of a stretch first and goes on behind it, so
    the stretches before and after each match are searched again.
    """
    found, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        # The space before a match and the one after it lie in the stretch too.
        m = one.pattern.search(text, a, b) if b - a >= len(one.text) - one.edits else None
        if m:
            found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            todo += [(a, m.start()), (m.end(), b)]
    return found


def settled(found: set[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """Of matches that overlap, that with fewest edits, then the longest, then the first. What is kept lies in order, so each is compared with two."""
    starts: list[int] = []
    kept: list[tuple[int, int, str, int, float]] = []
    for m in sorted(found, key=lambda m: (m[3], m[0] - m[1], m)):
        at = bisect_left(starts, m[0])
        if (at == 0 or kept[at - 1][1] <= m[0]) and (at == len(kept) or m[1] <= starts[at]):
            starts.insert(at, m[0])
            kept.insert(at, m)
    return kept


def matches(text: bytes) -> list[tuple[int, int, str, int, float]]:
    """Spans of notices in a normal text: start, end, label, edits, similarity; the better of two that overlap."""
    found = set()
    for one in notices():
        for a, b in candidates(text, one):
            for start, end, edits in best_matches(text, one, a, b):
                found.add((start, end, one.label, edits, 1.0 - edits / len(one.text)))
    return settled(found)


WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scan_text(text: str | None) -> dict:
    """Counts, labels and spans of one text; spans are code points of the text as given, end exclusive."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split(b" ")
    words = [w for w in words if w]
    normal = b" " + b" ".join(words) + b" "
    # The number of a word is that of the spaces before it, less the first.
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    starts: list[int] = []
    base_labels = set()
    for phrase, label in PHRASES.items():
        at = places(normal, b" " + phrase.encode() + b" ")
        if at:
            starts += np.searchsorted(spaces, at).tolist()
            base_labels.add(label)
    spans = []
    found = matches(normal)
    if found:
        bounds = [(m.start(), m.end()) for m in WORD.finditer(text.translate(ASCII_LOWER))]
        for a, b, label, edits, similarity in found:
            first, last = (np.searchsorted(spaces, (a, b)) - 1).tolist()
            spans.append((label, bounds[first][0], bounds[last][1], first, edits, similarity))
    score = 1.0 if starts else max((s[5] for s in spans), default=0.0)
    return {
        "n_words": len(words),
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(base_labels | {s[0] for s in spans})),
        "score": score,
        "spans": [dict(zip(("label", "start", "end", "first_word", "edits", "similarity"), s, strict=True)) for s in spans],
    }


ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the plain phrases, labels, best similarity and spans.

    A null text counts as empty: no words, no labels, score 0. Repeated rows are
    scanned each for itself; of spans that overlap, the one with fewest edits
    (then the longest, then the first) stands. Other columns are ignored.
    """

    def scan(batch):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for a, b in slices(texts):
            rows = [scan_text(t) for t in texts[a:b]]
            yield {"doc_id": ids.slice(a, b - a)} | {k: [r[k] for r in rows] for k in rows[0]}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, SCAN)
