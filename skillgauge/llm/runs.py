"""Periodic runs of words: all stretches that repeat with a period, each as long as it goes.

For every period p, a stretch of 2 p words or more covers two neighbouring points
of the grid 0, p, 2 p ... . So each pair of neighbouring points that hold the same
word is asked how far the text agrees behind and before it; what both ways
give p words or more is a run. All grids together have n log n points (a harmonic sum).

How far two places agree is answered by a difference cover: of the suffixes, only those at
residues of `COVER` modulo `MODULUS` are sorted. From any two places there
are less than `MODULUS` words to two sampled places at the same distance; those words
are compared, the rest is the least common prefix between two sorted samples, from
a sparse table. Texts of which no question gets that far are never sorted.

Several texts of similar length are worked on together as one array of word numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

# A run has this many words at least, and this many periods.
SHORTEST, PERIODS = 12, 2

# Every difference modulo MODULUS is one of two members of COVER.
MODULUS, COVER = 7, (1, 2, 4)
# Grid points that are looked at together.
TOGETHER = 1 << 20
# Periods up to this bound take a strided view each, greater ones are laid out together.
STRIDED = 64
# Texts of a batch that are searched together, in characters.
SLICE = 2_000_000

FOUND = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

SAMPLED = np.zeros(MODULUS, bool)
SAMPLED[list(COVER)] = True
# Words from two residues to the next places that are both sampled.
SHIFT = np.array([[next(d for d in range(MODULUS) if SAMPLED[(a + d) % MODULUS] and SAMPLED[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)])


class Agreement:
    """How many words agree from two places of one text on, for arrays of places.

    `codes` are word numbers from 1 on, `ends` gives for each place where its text ends.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        self.codes, self.ends = codes, ends
        self.samples: Samples | None = None

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j > i on, up to the end of the text; places may be at its end."""
        out = np.zeros(len(i), np.int64)
        some = np.flatnonzero(j < len(self.codes))
        room = np.zeros(len(i), np.int64)
        room[some] = self.ends[i[some]] - j[some]
        shift = SHIFT[i % MODULUS, j % MODULUS]
        goal = np.minimum(shift, room)
        open_ = np.flatnonzero(goal > 0)
        for step in range(MODULUS - 1):
            if not len(open_):
                break
            open_ = open_[goal[open_] > step]
            open_ = open_[self.codes[i[open_] + step] == self.codes[j[open_] + step]]
            out[open_] += 1
        far = np.flatnonzero((out == shift) & (room > shift))
        if len(far):
            if self.samples is None:
                self.samples = Samples(self.codes, self.ends, i[far])
            elif not self.samples.holds(i[far]):
                self.samples = Samples(self.codes, self.ends, np.concatenate([self.samples.texts, i[far]]))
            out[far] += self.samples.common(i[far] + shift[far], j[far] + shift[far])
        return out


class Samples:
    """The sorted suffixes at sampled places of those texts that `places` lie in, and a sparse table over their common prefixes."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, places: np.ndarray):
        self.codes, self.ends = codes, ends
        wanted = np.zeros(len(codes) + 1, bool)
        wanted[ends[places]] = True
        self.wanted = wanted
        at = np.flatnonzero(wanted[ends] & SAMPLED[np.arange(len(codes)) % MODULUS])
        # One place of every text that is held.
        self.texts = np.flatnonzero(wanted) - 1
        self.at, stop = at, ends[at]
        n = len(at)
        number = np.full(len(codes) + 1, -1, np.int64)
        number[at] = np.arange(n)
        # Suffixes start out ordered by their first MODULUS words; behind the end of a text stands 0, below every word.
        words = np.stack([np.where(at + k < stop, codes[np.minimum(at + k, len(codes) - 1)], 0) for k in range(MODULUS)])
        order = np.lexsort((*words[::-1], stop))
        new = np.ones(n, bool)
        new[1:] = (words[:, order][:, 1:] != words[:, order][:, :-1]).any(0) | (stop[order][1:] != stop[order][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = first
        # ranks[k] orders by the first MODULUS * 2 ** k words; only suffixes that are still equal are sorted again.
        self.ranks, width = [rank], MODULUS
        while True:
            single = new & np.append(new[1:], True)
            tied = np.flatnonzero(~single)
            if not len(tied):
                break
            mine = order[tied]
            on = at[mine] + width
            second = np.where(on < stop[mine], rank[np.maximum(number[np.minimum(on, len(codes))], 0)], -1)
            again = np.lexsort((second, rank[mine]))
            order[tied] = mine[again]
            split = np.ones(len(tied), bool)
            r, s = rank[mine][again], second[again]
            split[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
            new[tied] = split
            first = np.maximum.accumulate(np.where(split, tied, 0))
            rank = rank.copy()
            rank[order[tied]] = first
            self.ranks.append(rank)
            width *= 2
        self.rank, self.number = rank, number
        self.table = sparse_table(self.neighbours(order))

    def holds(self, places: np.ndarray) -> bool:
        return bool(self.wanted[self.ends[places]].all())

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """Words that each sorted suffix has in common with the one before it; of different texts none count."""
        out = np.zeros(len(order), np.int64)
        a, b = self.at[order[:-1]], self.at[order[1:]]
        stop = self.ends[b]
        same = np.flatnonzero(self.ends[a] == stop)
        a, b, stop = a[same], b[same], stop[same]
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.ranks[k], MODULUS << k
            x, y = a + common, b + common
            fits = np.flatnonzero(np.maximum(x, y) + width <= stop)
            equal = fits[rank[self.number[x[fits]]] == rank[self.number[y[fits]]]]
            common[equal] += width
        # Less than MODULUS words are left to compare.
        open_ = np.arange(len(a))
        for _ in range(MODULUS - 1):
            x, y = a[open_] + common[open_], b[open_] + common[open_]
            open_ = open_[np.maximum(x, y) < stop[open_]]
            open_ = open_[self.codes[a[open_] + common[open_]] == self.codes[b[open_] + common[open_]]]
            common[open_] += 1
        out[same + 1] = common
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from the sampled places i and j on."""
        x, y = self.rank[self.number[i]], self.rank[self.number[j]]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Least values of all stretches whose length is a power of two."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def grid(codes: np.ndarray, text: np.ndarray, most: int):
    """Arrays (i, p) of grid points i and periods p up to `most` with the same word at i and i + p of one text, piece by piece."""
    n = len(codes)
    for p in range(1, min(most, STRIDED) + 1):
        some = codes[::p]
        i = np.flatnonzero(some[1:] == some[:-1]) * p
        i = i[text[i] == text[i + p]]
        if len(i):
            yield i, np.full(len(i), p)
    p = STRIDED + 1
    while p <= most:
        last = min(most, max(p, p + TOGETHER * p // n))
        periods = np.arange(p, last + 1)
        points = (n - 1) // periods
        of = np.repeat(periods, points)
        i = (np.arange(len(of)) - np.repeat(np.cumsum(points) - points, points)) * of
        same = np.flatnonzero(codes[i] == codes[i + of])
        i, of = i[same], of[same]
        same = text[i] == text[i + of]
        yield i[same], of[same]
        p = last + 1


def pooled(pieces):
    """The pieces of a grid put together, so that each question is asked for many points at once."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= TOGETHER:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def all_runs(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of several texts, in this order; starts count from each text's first word."""
    n = len(codes)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts = ends - sizes
    ahead = Agreement(codes, ends[text])
    behind = Agreement(codes[::-1], (n - starts[text])[::-1])
    # Stretches as one number, start and end, each with its least period: that is the run's, its multiples are periods too.
    stretch, period = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, p in pooled(grid(codes, text, int(sizes.max(initial=0)) // PERIODS)):
        j = i + p
        on = ahead.of(i, j)
        back = behind.of(n - j, n - i)
        keep = (on + back >= p * (PERIODS - 1)) & (on + back + p >= SHORTEST)
        stretch = np.concatenate([stretch, ((i - back)[keep] << np.int64(32)) | (j + on)[keep]])
        period = np.concatenate([period, p[keep]])
        order = np.lexsort((period, stretch))
        first = order[np.flatnonzero(np.diff(stretch[order], prepend=-1))]
        stretch, period = stretch[first], period[first]
    begin, end = stretch >> np.int64(32), stretch & np.int64((1 << 32) - 1)
    rows = np.stack([text[begin], begin - starts[text[begin]], end - begin, period], axis=1)
    # By start and then period.
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def runs_of(lists: list[list[bytes]]) -> dict[int, np.ndarray]:
    """For the texts that have runs, by index: rows (start, length, period), by start and period. Texts are searched with others of similar length."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    class_ = np.where(sizes >= SHORTEST, np.frexp(sizes.astype(float))[1], 0)
    out = {}
    for c in np.unique(class_[class_ > 0]).tolist():
        some = np.flatnonzero(class_ == c)
        flat = pa.array([w for k in some.tolist() for w in lists[k]], pa.binary()).dictionary_encode()
        rows = all_runs(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, sizes[some])
        cuts = [*np.flatnonzero(np.diff(rows[:, 0], prepend=-1)).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[int(some[rows[a, 0]])] = rows[a:b, 1:]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds behind its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, its runs by start and period, and its words without repetitions, joined by a space.

    Words are what stands between white space (space and 0x09-0x0D), compared as they
    are; `change` may replace a document's words before they are searched. A null text has no words, no runs and an
    empty collapsed text. Repeated rows are searched each for itself. Other columns are ignored.
    """
    flat = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in slices(texts, SLICE):
            lists = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[a:b]]
            if change is not None:
                lists = [change(i, words) for i, words in zip(ids[a:b], lists, strict=True)]
            found = runs_of(lists)
            kept = [collapsed(words, found[k]) if k in found else words for k, words in enumerate(lists)]
            yield {
                "doc_id": ids[a:b],
                "n_words": [len(words) for words in lists],
                "runs": [[{"start": s, "length": n, "period": p} for s, n, p in found[k].tolist()] if k in found else [] for k in range(len(lists))],
                "collapsed": [b" ".join(words).decode("utf-8", "surrogatepass") for words in kept],
            }

    return arrow_map(flat, run, FOUND)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by crc32 of its id, repeats a stretch from some word on; one without an id stays as it is."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digests(found: DataFrame) -> DataFrame:
    """Of `periodic_runs`: number of runs, the longest one (then the first, then that of least period), and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    held = found.withColumn("best", best)
    return held.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(1000 * -F.col("best.l") / F.col("best.p")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
