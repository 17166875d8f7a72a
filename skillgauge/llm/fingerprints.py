"""Fingerprints of improbable features: Bloom filters of the rarest byte windows of a text.

1. Every window of `WINDOW` bytes of the UTF-8 text has an entropy, in steps of
   1/256 bit. How often each step occurs in all texts says how improbable it is:
   the rarest step has rank 0.
2. A second window slides over `SPAN` neighbouring positions and votes for the lowest rank,
   the leftmost of several. Positions with `VOTES` votes are the features, so
   what is chosen depends on the text near it alone.
3. Features, each once, are hashed into Bloom filters: `FEATURES` fill one, then the next of the chain begins.
4. Two fingerprints are alike as far as their filters' bits overlap: over what
   chance gives, relative to the larger number of bits; each filter counts by its features, with its best match.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, mixed, partition_map, slices

WINDOW = SPAN = 32
VOTES = SPAN // 4
BITS, HASHES, FEATURES = 2048, 5, 128
WORDS = BITS // 64
# Sums c * log2(c) of a window in units of 2**-20; its entropy in bits is (FULL - sum) / (WINDOW * 2**20).
UNIT = 1 << 20
COST = np.array([0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)], np.int32)
GAIN = np.diff(COST)
FULL = int(COST[WINDOW])
STEP_BITS = 17
STEPS = (FULL >> STEP_BITS) + 1
# Bytes whose windows are counted at once, so that the work stays in a core's cache.
CHUNK = 1 << 16
NEVER = np.int64(1) << np.int64(62)
# Texts of a task that are fingerprinted together, in characters.
TOGETHER = 250_000

COLUMNS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ENDS = "part int, doc_id bigint, text string, head string"


class Bytes:
    """Texts as one array of bytes; a text shorter than a window is filled up with zeros, an empty one has no window."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        parts = [p.ljust(WINDOW, b"\0") if p else p for p in parts]
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(sizes) - sizes
        self.full = np.flatnonzero(sizes)
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.starts[self.full]] += 1
        edge[(self.starts + sizes - WINDOW + 1)[self.full]] -= 1
        # Whether a position starts a window within one text: not so for the last WINDOW - 1.
        self.inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """The entropy step of the window at every position but the last WINDOW - 1.

    From one window to the next one byte leaves and one enters; how often each
    stands in the bytes before or behind it comes from comparing the array with itself, shifted.
    """
    out = np.empty(max(0, len(data) - WINDOW + 1), np.int16)
    for a in range(0, len(out), CHUNK):
        part = data[a : a + CHUNK + WINDOW - 1]
        ahead, behind = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for k in range(1, WINDOW):
            same = (part[:-k] == part[k:]).view(np.uint8)
            ahead[:-k] += same
            behind[k:] += same
        change = GAIN[behind[WINDOW:]] - GAIN[ahead[:-WINDOW]]
        first = int(COST[np.bincount(part[:WINDOW], minlength=1)].sum())
        cost = np.empty(len(change) + 1, np.int32)
        cost[0] = first
        np.cumsum(change, out=cost[1:])
        cost[1:] += first
        out[a : a + CHUNK] = (FULL - cost) >> STEP_BITS
    return out


def chosen(texts: Bytes, ranks: np.ndarray) -> np.ndarray:
    """Positions of the features of all texts, ascending."""
    n = len(texts.data)
    if n == 0:
        return np.zeros(0, np.int64)
    key = np.full(n + SPAN - 1, NEVER, np.int64)
    inside = np.flatnonzero(texts.inside)
    # Texts end with WINDOW - 1 positions without a window, so no vote is between two texts.
    key[SPAN - 1 + inside] = (ranks[entropy_steps(texts.data)[inside]] << np.int64(40)) | inside
    width = 1
    while width < SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    votes = np.bincount(key[key < NEVER] & ((np.int64(1) << np.int64(40)) - 1))
    return np.flatnonzero(votes >= VOTES)


class Digests:
    """Chains of Bloom filters of several texts: `filters` holds them all, those of text i from `ends[i - 1]` to `ends[i]`."""

    def __init__(self, texts: list[str], ranks: np.ndarray):
        held = Bytes(texts)
        at = chosen(held, ranks)
        owner = held.full[np.searchsorted(held.starts[held.full], at, "right") - 1]
        if len(at):
            words = np.lib.stride_tricks.sliding_window_view(held.data, WINDOW)[at].view(np.uint64)
        else:
            words = np.zeros((0, WINDOW // 8), np.uint64)
        h = np.zeros(len(at), np.uint64)
        for k in range(words.shape[1]):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k] + np.uint64(k + 1))
        # Each feature counts once, at its first place.
        order = np.lexsort((at, h, owner))
        again = np.zeros(len(at), bool)
        again[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        keep = np.sort(order[~again])
        h, owner = h[keep], owner[keep]
        self.features = np.bincount(owner, minlength=len(texts))
        sizes = -(-self.features // FEATURES)
        self.ends = np.cumsum(sizes)
        begin = self.ends - sizes
        number = np.arange(len(h)) - np.repeat(np.cumsum(self.features) - self.features, self.features)
        of = begin[owner] + number // FEATURES
        total = int(sizes.sum())
        self.weights = np.bincount(of, minlength=total)
        bits = np.zeros((total, BITS), bool)
        for k in range(HASHES):
            bits[of, (h >> np.uint64(11 * k)) % np.uint64(BITS)] = True
        self.filters = np.packbits(bits, axis=1).view(np.uint64).reshape(total, WORDS)
        self.bits = np.bitwise_count(self.filters).sum(1, dtype=np.int64)

    def of(self, i: int) -> slice:
        return slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def shown(self, i: int) -> str:
        """Number of features and the filters in base 64."""
        return f"{self.features[i]}:{base64.b64encode(self.filters[self.of(i)].tobytes()).decode()}"

    def likeness(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How alike the texts left[k] and right[k] are, from 0 to 1; two without features are equal."""
        out = np.zeros(len(left))
        counts = np.diff(self.ends, prepend=0)
        none = (counts[left] == 0) & (counts[right] == 0)
        out[none] = 1.0
        single = (counts[left] == 1) & (counts[right] == 1)
        a, b = self.ends[left[single]] - 1, self.ends[right[single]] - 1
        common = np.bitwise_count(self.filters[a] & self.filters[b]).sum(1, dtype=np.int64)
        out[single] = overlap(common, self.bits[a], self.bits[b])
        for k in np.flatnonzero(~single & (counts[left] > 0) & (counts[right] > 0)).tolist():
            out[k] = self.chains(self.of(left[k]), self.of(right[k]))
        return out

    def chains(self, a: slice, b: slice) -> float:
        """Mean over the features of both texts of the best overlap of their filter with one of the other text."""
        right = self.filters[b]
        best_a, best_b = np.zeros(a.stop - a.start), np.zeros(b.stop - b.start)
        rows = max(1, (1 << 21) // right.size)
        for i in range(a.start, a.stop, rows):
            j = min(a.stop, i + rows)
            common = np.bitwise_count(self.filters[i:j, None, :] & right[None, :, :]).sum(2, dtype=np.int64)
            alike = overlap(common, self.bits[i:j, None], self.bits[None, b])
            best_a[i - a.start : j - a.start] = alike.max(1)
            np.maximum(best_b, alike.max(0), out=best_b)
        wa, wb = self.weights[a], self.weights[b]
        return float((best_a @ wa + best_b @ wb) / (wa.sum() + wb.sum()))


def overlap(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bits of filters with a and b bits: 0 up to two deviations over chance, 1 where all of the larger are common."""
    chance = a * b / BITS
    spread = np.sqrt(a * b * (BITS - a) * (BITS - b) / (BITS * BITS * (BITS - 1.0)))
    floor, top = chance + 2 * spread, np.maximum(a, b)
    part = (common - floor) / np.where(top > floor, top - floor, 1.0)
    return np.where(common == top, 1.0, np.clip(part, 0.0, 1.0))


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def fit(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy step: how many steps are rarer in the windows of all texts; ties by the step."""

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(STEPS, np.int64)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts, TOGETHER):
                held = Bytes(texts[a:b])
                steps = entropy_steps(held.data)
                total += np.bincount(steps[held.inside[: len(steps)]], minlength=STEPS)
        seen = np.flatnonzero(total)
        yield {"step": seen, "n": total[seen]}

    found = partition_map(docs.select(F.col("text").cast("string").alias("text")), count, "step int, n bigint")
    counts = np.zeros(STEPS, np.int64)
    for row in found.groupBy("step").agg(F.sum("n").alias("n")).collect():  # at most STEPS rows
        counts[row["step"]] = row["n"]
    ranks = np.empty(STEPS, np.int64)
    ranks[np.lexsort((np.arange(STEPS), counts))] = np.arange(STEPS)
    return ranks


def edited(text: str, following: str) -> str:
    """The last half of `text` gives way to as much of the head of `following`."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(ids: list, texts: list[str], ranks: np.ndarray) -> dict:
    """Result columns for all texts but the last, each with the one behind it as its next."""
    n = len(texts) - 1
    changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
    digests = Digests(texts + changed, ranks)
    own = np.arange(n)
    return {
        "doc_id": ids[:n],
        "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [digests.shown(i) for i in range(n)],
        "edited_fingerprint": [digests.shown(n + 1 + i) for i in range(n)],
        "near_edited": digests.likeness(own, own + n + 1),
        "near_next": digests.likeness(own, own + 1),
    }


def ordered(docs: DataFrame) -> DataFrame:
    """Ids and texts in descending order of the id, by ranges: the rows of a partition are neighbours, partitions follow each other.

    Rows without an id are last; rows with one id are ordered by hash and text, and
    dealt by the hash too, so an id with many rows is no hot range. The number of
    ranges is that of the session's shuffle partitions and is not changed at run time.
    """
    flat = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    down = F.col("doc_id").desc_nulls_last()
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = flat.withColumn("h", F.xxhash64("text")).repartitionByRange(ranges, down, "h")
    return spread.sortWithinPartitions(down, "h", "text").select("doc_id", "text")


def fingerprints(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """One row per document: its fingerprint and that of its edited text, and how alike they and the next document are.

    The next document is the one behind in descending order of doc_id, after the
    last the first. A null text counts as empty and has the fingerprint of no feature; two such are equal. Rows
    without an id are last, rows with one id in an order of their texts. Equal
    texts have equal fingerprints. An empty table has no rows; a single document is its own next. Other columns are ignored.
    """
    rows = ordered(docs)

    def within(batches: Iterator[pa.RecordBatch]):
        ids, texts = [], []
        for batch in batches:
            more, some = batch.column("doc_id").to_pylist(), texts_of(batch)
            for a, b in slices(some, TOGETHER):
                ids, texts = ids + more[a:b], texts + some[a:b]
                yield compared(ids, texts, ranks)
                ids, texts = ids[-1:], texts[-1:]

    def ends(batches: Iterator[pa.RecordBatch]):
        first, part = None, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                first = batch.slice(0, 1) if first is None else first
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield {"part": [part], "doc_id": last.column("doc_id"), "text": last.column("text"), "head": texts_of(first)}

    def between(batch: pa.RecordBatch):
        behind = batch.column("following").to_pylist()
        for k, (i, t) in enumerate(zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True)):
            yield compared([i, None], [t, behind[k] or ""], ranks)

    inside = partition_map(rows, within, COLUMNS)
    # The last row of a range has its next in the first of the following range; the last range's is the first of all.
    edge = partition_map(rows, ends, ENDS)
    line = Window.orderBy("part")  # a row for each range
    following = F.coalesce(F.lead("head").over(line), F.first("head").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tails = edge.select("doc_id", "text", following.alias("following"))
    return inside.unionByName(arrow_map(tails, between, COLUMNS))
