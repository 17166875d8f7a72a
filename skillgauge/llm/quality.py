"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials
over the buckets, one of trusted documents and one of all documents, give each
document the mean of log p(target) - log p(raw) over its n-grams. Every document
whose mean lies under the threshold is turned down; so is one that fails a plain
rule (few words, or mostly repeated word triples).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles
from .common import LOWER, Words, arrow_filter, arrow_map, mixed, partition_map, possible, settled, slices, stored

BUCKETS = 1 << 16
SMOOTHING = 1.0
# The share of trusted documents that may lie under the threshold.
TRUSTED_LOSS = 0.002
MIN_WORDS = 50
MAX_REPEATED = 0.5
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
SPACE = b" \t\n\x0b\x0c\r"
# UTF-8 continuation bytes, which are no characters of their own, and white space.
NO_CHARACTERS = bytes(range(0x80, 0xC0)) + SPACE

PROFILE = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, llr double"
)


@dataclass(frozen=True)
class TargetModel:
    """Log ratios of the buckets (bounded by their number) and the threshold."""

    ratio: np.ndarray
    threshold: float


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each lower-case word and word pair of all texts, and the index of its text."""
    hashes = np.fromiter((zlib.crc32(w.translate(LOWER)) for w in words.vocabulary), np.uint64, len(words.vocabulary))
    h = hashes[words.codes]
    owner = words.owner()
    ones = mixed(h)
    with np.errstate(over="ignore"):
        pairs = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1))
    inside = owner[:-1] == owner[1:]
    buckets = np.concatenate([ones, pairs[inside]]) & np.uint64(BUCKETS - 1)
    return buckets.astype(np.int64), np.concatenate([owner, owner[:-1][inside]])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts: one vector per partition, summed by bucket.

    The driver gets one row per bucket, whose number is fixed.
    """

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                total += np.bincount(features(Words(texts[a:b]))[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield {"bucket": used, "n": total[used]}

    partial = partition_map(docs.select("text"), count, "bucket int, n bigint")
    rows = partial.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def fit(docs: DataFrame, labels: DataFrame) -> TargetModel:
    """The model of all documents (raw) and of all that are labelled good (target).

    Half of the labelled ids, by their hash, gives the target, the other half the
    threshold: the value that all but `TRUSTED_LOSS` of it reach. An id counts once, in
    the target by its least text, for the threshold by its least ratio.
    Without labelled good documents nothing is turned down by the ratio.
    """
    raw = bucket_counts(docs)
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    # Only the texts of one half meet the labels; of the other half their ratios do.
    texts = docs.select("doc_id", "text")
    # Only texts whose rows cannot be told from others by their ids' bits are shuffled.
    sure, rest = settled(possible(texts.where(half), ids), ids)
    first = rest.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    target = bucket_counts(sure.unionByName(first))
    if not target.sum():
        return TargetModel(np.zeros(BUCKETS, np.float32), -np.inf)
    smooth = SMOOTHING * raw + SMOOTHING  # the raw corpus is the prior of the target
    prior = smooth / smooth.sum()
    weight = BUCKETS * 0.5
    p_target = (target + weight * prior) / (target.sum() + weight)
    ratio = np.log(p_target) - np.log(prior)
    others = score(texts.where(~half), TargetModel(ratio.astype(np.float32), -np.inf)).select("doc_id", "llr", "base_failed")
    least = others.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("llr", "base_failed")).alias("s")).select("s.*")
    # They are read more than once to find the rank. One row, or none.
    ratios = stored(least.where("NOT base_failed").select("llr"), "trusted-ratios")
    threshold = exact_quantiles(ratios, "llr", (100 * TRUSTED_LOSS,)).first()
    return TargetModel(ratio.astype(np.float32), -np.inf if threshold is None else float(threshold["value"]))


def repeated_words(words: Words) -> np.ndarray:
    """Per text: words that stand in a window of three which occurs twice or more in the text."""
    n = len(words.codes)
    out = np.zeros(len(words.counts), np.int64)
    if n < 3:
        return out
    owner = words.owner()
    at = np.flatnonzero(owner[:-2] == owner[2:])
    if not len(at):
        return out
    c, size = words.codes, len(words.vocabulary)
    pair = np.unique(c[at] * size + c[at + 1], return_inverse=True)[1]
    triple = np.unique(pair * size + c[at + 2], return_inverse=True)[1]
    key = np.unique(triple * len(words.counts) + owner[at], return_inverse=True, return_counts=True)
    again = at[key[2][key[1]] > 1]
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[again + shift] = True
    return np.bincount(owner[covered], minlength=len(out))


def duplicate_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACE):
            seen.add(line)
    return again


def judge(texts: list[str | None], model: TargetModel) -> dict:
    """The columns of `score` for some texts, but for the id."""
    words = Words(texts)
    buckets, owner = features(words)
    sums = np.bincount(owner, weights=model.ratio[buckets], minlength=len(texts))
    llr = sums / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    repeat = repeated_words(words)
    failed = (words.counts < MIN_WORDS) | (repeat > MAX_REPEATED * words.counts)
    return {
        "n_words": words.counts,
        "word_chars": [len(t.translate(None, NO_CHARACTERS)) for t in raw],
        "n_symbols": [len(t.translate(None, NOT_SYMBOLS)) for t in raw],
        "n_dup_lines": [duplicate_lines(t) for t in raw],
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": ~failed & (llr >= model.threshold),
        "llr": llr,
    }


def score(docs: DataFrame, model: TargetModel) -> DataFrame:
    """One row per document: counts of the plain rules, mean log ratio `llr` and the verdict.

    A null text has no words; it and an empty text fail the word rule. Texts
    without n-grams have the ratio 0. Repeated rows are judged each for itself.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batch):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for a, b in slices(texts):
            yield {"doc_id": ids.slice(a, b - a)} | judge(texts[a:b], held.value)

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PROFILE)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on `labels` and all of `docs`, then judge every document."""
    return score(docs, fit(docs, labels))


def kept(docs: DataFrame, model: TargetModel) -> DataFrame:
    """The documents, with all their columns, that pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_filter(docs, lambda texts: judge(texts, held.value)["kept"])
