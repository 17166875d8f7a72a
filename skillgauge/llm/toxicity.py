"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A window is one lower-case word, said three times so that its cost stands out
from the frame's fixed bytes. It is compressed with a dictionary of ordinary text
and with one that has toxic text before the same ordinary text; the bytes saved
are its distance. The distances of a document's windows, as a histogram, are
compared with those of labelled toxic and ordinary documents, and a logistic curve
turns that into a score between 0 and 1.

Labels are of documents, not of words. So the toxic dictionary is trained on the
words that stand in clearly more toxic than ordinary documents, copies and near
copies counting once.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_filter, arrow_map, partition_map, possible, slices, stored

# How many of the most usual ordinary words the driver gets for the ordinary dictionary.
MAX_ORDINARY_WORDS = 20_000
# Standard errors by which a word's share of toxic documents must exceed its share of the others.
MIN_Z = 6.0
ORDINARY_BYTES = 16_384
THRESHOLD = 0.3
REPEAT = 3
MATCH = 4
LOW, HIGH = -4, 24
# A longer run of letters is cut: no word has so many.
WORD = re.compile(rb"[a-z\x80-\xff]{1,64}")
CACHE = 1_000_000
FEATURES = 6
SUMS = "at int, v double"

SCORED = "doc_id bigint, score double, predicted int"


@dataclass(frozen=True)
class ToxicModel:
    """Two dictionaries, log ratios of the distances, and the curve; all of bounded size."""

    toxic: bytes
    ordinary: bytes
    ratios: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float
    key: str


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def window(word: bytes) -> bytes:
    return (b" " + word) * REPEAT + b" "


def grams(data: bytes) -> set[bytes]:
    return {data[i : i + MATCH] for i in range(len(data) - MATCH + 1)}


class Distances:
    """Bytes saved per word by the toxic dictionary.

    A window without a string of `MATCH` bytes of the toxic part cannot be helped
    by it: its distance is 0 without compressing.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.grams = grams(toxic)
        self.known: dict[bytes, int] = {}
        self.plain, self.both = compressor(ordinary), compressor(toxic + ordinary)

    def of(self, word: bytes) -> int:
        text = window(word)
        if self.grams.isdisjoint(grams(text[: 2 * len(word) + 2])):
            return 0
        return min(max(len(self.plain.compress(text)) - len(self.both.compress(text)), LOW), HIGH)

    def histogram(self, text: str | None) -> np.ndarray:
        found = words_of(text)
        fresh = set(found).difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = set(found)
        for word in fresh:
            self.known[word] = self.of(word)
        values = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        return np.bincount(values - LOW, minlength=HIGH - LOW + 1)


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    # The window and the tables of matches hold the whole dictionary.
    log = max(15, (2 * len(data)).bit_length())
    parameters = zstandard.ZstdCompressionParameters.from_level(
        5, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=MATCH, window_log=log, hash_log=log - 1, chain_log=log - 1, strategy=3
    )
    dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)


@functools.lru_cache(maxsize=2)
def distances(toxic: bytes, ordinary: bytes) -> Distances:
    """Kept by a worker over its tasks, so that frequent words are compressed once."""
    return Distances(toxic, ordinary)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer picks from the samples; the samples' own end where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def feature_sums(rows: DataFrame, ratios: np.ndarray, centre: np.ndarray, power: int) -> np.ndarray:
    """Sum over all documents of the features' distance from `centre`, to a power."""

    def add(batches):
        total = np.zeros(FEATURES)
        for batch in batches:
            total += ((features(histograms_of(batch), ratios) - centre) ** power).sum(0)
        yield {"at": np.arange(FEATURES), "v": total}

    return added(partition_map(rows.select("h"), add, SUMS), FEATURES)


def logit(rows: DataFrame, ratios: np.ndarray, mean: np.ndarray, scale: np.ndarray, counts: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic curve by Newton's method, with a small penalty that keeps the system regular; a row of label k counts counts[k] times.

    Each round sums slope and curvature over all documents, of which the driver gets a
    row per number, and the last is that in which the weights stand still.
    """
    w = np.zeros(FEATURES)
    for _ in range(rounds):

        def add(batches, w=w):
            slope, curve = np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))
            for batch in batches:
                x = (features(histograms_of(batch), ratios) - mean) / scale
                y = batch.column("toxic").to_numpy(zero_copy_only=False)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                slope += x.T @ (counts[y] * (y - p))
                curve += (x * (counts[y] * p * (1 - p))[:, None]).T @ x
            total = np.concatenate([slope, curve.ravel()])
            yield {"at": np.arange(len(total)), "v": total}

        total = added(partition_map(rows.select("toxic", "h"), add, SUMS), FEATURES * (FEATURES + 1))
        slope, curve = total[:FEATURES] - penalty * w, total[FEATURES:].reshape(FEATURES, FEATURES)
        step = np.linalg.solve(curve + penalty * np.eye(FEATURES), slope)
        w = w + step
        if np.abs(step).max() < 1e-9 * (1 + np.abs(w).max()):
            break
    return w


def added(partial: DataFrame, size: int) -> np.ndarray:
    """The vector of which `partial` has parts: one row per place, whose number is fixed."""
    out = np.zeros(size)
    for r in partial.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def histograms_of(batch) -> np.ndarray:
    column = batch.column("h")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), HIGH - LOW + 1).astype(float)


def features(histograms: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Evidence of all windows, of the telling ones, and their number, per document."""
    n = histograms.sum(1)
    up = histograms @ np.maximum(ratios, 0)
    strong = histograms @ np.where(ratios > 0.7, ratios, 0)
    return np.column_stack([np.ones(len(n)), histograms @ ratios, np.log1p(up), np.log1p(n), up / np.sqrt(n + 1), np.log1p(strong)])


def known_labels(labels: DataFrame, learn: Column) -> DataFrame:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn)
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def labelled(docs: DataFrame, one: DataFrame) -> DataFrame:
    """doc_id, label, family and text of every labelled document; an id counts once."""

    def describe(batch):
        families = []
        for text in batch.column("text").to_pylist():
            found = words_of(text)
            families.append(min(hash_of(b" ".join(found[i : i + 3])) for i in range(max(1, len(found) - 2))))
        yield {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "family": families, "text": batch.column("text")}

    joined = possible(docs.select("doc_id", "text"), one).join(one, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    described = arrow_map(joined.select("doc_id", "toxic", "text"), describe, "doc_id bigint, toxic int, family bigint, text string")
    return stored(described, "toxic-labelled")


def word_counts(single: DataFrame) -> DataFrame:
    """word, a, b: in how many toxic and in how many ordinary texts a word stands; a row per batch and word before the sum."""

    def count(batch):
        seen = (Counter(), Counter())
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen[toxic].update({w.decode("utf-8", "replace") for w in words_of(text)})
        words = list(seen[0].keys() | seen[1].keys())
        yield {"word": words, "a": [seen[1][w] for w in words], "b": [seen[0][w] for w in words]}

    each = arrow_map(single.select("toxic", "text"), count, "word string, a bigint, b bigint")
    return stored(each.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "toxic-words")


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) >> 1


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> ToxicModel:
    """The model of all labelled documents; `learn` says which ids of `labels` may be used.

    Without labels of both kinds nothing is found toxic.
    """
    one = known_labels(labels, F.lit(True) if learn is None else learn)
    all_sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # What the fold leaves out is known by the id alone, so its texts are not shuffled.
    known = labelled(docs if learn is None else docs.where(learn), one)
    # Near copies count once.
    single = stored(known.groupBy("toxic", "family").agg(F.min_by("text", "doc_id").alias("text")), "toxic-single")
    sizes = {r["toxic"]: r["n"] for r in single.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    empty = ToxicModel(b"", b"", np.zeros(HIGH - LOW + 1), np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, "")
    if not n1 or not n0:
        return empty
    counts = word_counts(single)
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    telling = counts.where("a >= 3").withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy("z", "word").collect()
    usual = counts.where("b > 0").orderBy(F.desc("b"), "word").limit(MAX_ORDINARY_WORDS).collect()
    if not telling:
        return empty
    # The windows of all telling words: the dictionary grows with their number.
    toxic = b"".join(window(r["word"].encode()) for r in telling)
    ordinary = dictionary([b" " + r["word"].encode() + b" " for r in usual for _ in range(min(r["b"], 20))], ORDINARY_BYTES)

    def measure(batch):
        rows = [distances(toxic, ordinary).histogram(t) for t in batch.column("text").to_pylist()]
        yield {"toxic": batch.column("toxic"), "h": [r.tolist() for r in rows]}

    rows = arrow_map(known.select("toxic", "text"), measure, "toxic int, h array<bigint>")
    rows = stored(rows, "toxic-distances")
    cells = rows.select("toxic", F.posexplode("h").alias("at", "v")).groupBy("toxic", "at").agg(F.sum("v").alias("v"))
    shares, measured = np.full((2, HIGH - LOW + 1), 0.5), np.zeros(2)
    for r in cells.collect():
        shares[r["toxic"], r["at"]] += r["v"]
    for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect():
        measured[r["toxic"]] = r["n"]
    ratios = np.log(shares[1] / shares[1].sum()) - np.log(shares[0] / shares[0].sum())
    mean = feature_sums(rows, ratios, np.zeros(FEATURES), 1) / measured.sum()
    scale = np.sqrt(feature_sums(rows, ratios, mean, 2) / measured.sum())
    mean[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    # Labels without a document change the proportion of the labels; the curve is fitted to the true one.
    often = np.array([all_sizes[0], all_sizes[1]]) / np.maximum(1, measured)
    often /= (often * measured).sum() / measured.sum()
    weights = logit(rows, ratios, mean, scale, often)
    return ToxicModel(toxic, ordinary, ratios, mean, scale, weights, all_sizes[1] / (all_sizes[0] + all_sizes[1]), uuid.uuid4().hex)


def judge(texts: list[str | None], model: ToxicModel) -> np.ndarray:
    if not model.key:
        return np.zeros(len(texts))
    of = distances(model.toxic, model.ordinary)
    histograms = np.array([of.histogram(t) for t in texts], float).reshape(len(texts), -1)
    x = (features(histograms, model.ratios) - model.mean) / model.scale
    return np.where(histograms.sum(1) > 0, 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))), model.prior)


def score(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: score (higher: label 1 is likelier) and verdict.

    Null and empty texts have no windows; their score is the share of toxic labels.
    Repeated rows are scored each for itself. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few ten kilobytes

    def run(batch):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for a, b in slices(texts):
            s = judge(texts[a:b], held.value)
            yield {"doc_id": ids.slice(a, b - a), "score": s, "predicted": (s >= threshold).astype(np.int32)}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCORED)


def kept(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that are not found toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_filter(docs, lambda texts: judge(texts, held.value) < threshold)
