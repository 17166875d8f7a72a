"""Language ID as inference of a mixture of languages.

Each language is a multinomial over hashed character n-grams, counted over all
training documents. The units of a document are its runs of letters; a unit has
one likelihood per language, the product over its n-grams. Expectation
maximisation finds the proportions of the languages in a document. Sets of
languages that grow in order of their proportions are compared by likelihood less
a penalty for each further language; the largest proportion of the best set is
the prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partition_map, slices

BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 12
# Share of a further language in the penalty: half the logarithm of the number of units, times this.
PENALTY = 3.0
# Units are at most so long, so that text without spaces is many units.
UNIT = re.compile(r"[^\W\d_]{1,16}")
# Word characters that are no decimal digits also hold numbers such as fractions and Roman numerals, which are no letters.
LETTERS = regex.compile(r"\p{L}{1,16}")
UNKNOWN = "und"

PREDICTED = "doc_id bigint, lang_pred string, score double, languages string"


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities: a row of BUCKETS values for each language."""

    names: list[str]
    table: np.ndarray


def letters(text: str) -> list[str]:
    """Runs of letters, which are the characters of the general category L, of at most 16 characters."""
    found = UNIT.findall(text)
    return found if not found or "".join(found).isalpha() else LETTERS.findall(text)


class Units:
    """Runs of letters of several texts, in lower case, as codes into distinct units."""

    def __init__(self, texts: list[str | None]):
        lists = [letters((t or "").lower()) for t in texts]
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        encoded = pa.array([u for units in lists for u in units], pa.string()).dictionary_encode()
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = encoded.dictionary.to_pylist()
        self.owner = np.repeat(np.arange(len(lists)), self.counts)


def unit_grams(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams (one to three characters, with word edges) of all units, and the unit of each."""
    if not units:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = " " + "  ".join(units) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, units), np.int64, len(units)) + 2
    owner = np.repeat(np.arange(len(units)), lengths)
    out, owners = [], []
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            h = np.full(len(points) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h + points[i : len(points) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = owner[: len(h)] == owner[n - 1 :]
            if n == 1:
                inside &= points != 32
            out.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[: len(h)][inside])
    return np.concatenate(out), np.concatenate(owners)


def fit(docs: DataFrame, learn: Column | None = None) -> LanguageModel:
    """N-gram counts by language of all documents with a language that `learn` allows.

    The driver gets BUCKETS numbers for each language of the corpus.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known if learn is None else known.where(learn)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
            for a, b in slices(texts):
                units = Units(texts[a:b])
                buckets, owner = unit_grams(units.distinct)
                for lang in set(langs[a:b]):
                    mine = units.codes[(langs[a:b] == lang)[units.owner]]
                    often = np.bincount(mine, minlength=len(units.distinct))
                    total = np.bincount(buckets, weights=often[owner], minlength=BUCKETS)
                    totals[lang] = totals.get(lang, 0) + total
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield {"lang": [lang] * len(used), "bucket": used, "n": total[used].astype(np.int64)}

    counted = partition_map(known.select("text", "lang"), count, "lang string, bucket int, n bigint")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    table = np.full((len(names), BUCKETS), SMOOTHING)
    table[np.searchsorted(names, rows["lang"].to_numpy(str)), rows["bucket"].to_numpy()] += rows["n"].to_numpy() if names else []
    return LanguageModel(names, (np.log(table) - np.log(table.sum(1, keepdims=True))).astype(np.float32))


def mixture(likelihood: np.ndarray, owner: np.ndarray, allowed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages per document by expectation maximisation, and the log likelihood.

    likelihood: units x languages, scaled so that a unit's best is 1. Documents
    without units keep even proportions.
    """
    share = (allowed / np.maximum(allowed.sum(1, keepdims=True), 1)).astype(np.float32)
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    some = counts > 0
    for _ in range(ROUNDS if allowed.sum(1).max(initial=0) > 1 else 0):
        joint = likelihood * share[owner]
        joint /= np.maximum(joint.sum(1, keepdims=True), 1e-30)
        share[some] = np.add.reduceat(joint, at[some]) / counts[some][:, None]
    total = np.zeros(len(counts))
    total[some] = np.add.reduceat(np.log(np.maximum((likelihood * share[owner]).sum(1), 1e-30)), at[some])
    return share, total


def infer(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray, list[str]]:
    """Prediction, its proportion, and the chosen languages with their proportions, for each text."""
    units = Units(texts)
    n, k = len(texts), len(model.names)
    if not k or not len(units.codes):
        return [UNKNOWN] * n, np.zeros(n), [""] * n
    buckets, owner = unit_grams(units.distinct)
    starts = np.bincount(owner, minlength=len(units.distinct))
    order = np.argsort(owner, kind="stable")
    at = np.concatenate([[0], np.cumsum(starts)[:-1]])
    logs = np.stack([np.add.reduceat(row[buckets[order]].astype(float), at) for row in model.table], axis=1)
    best = logs.max(1, keepdims=True)
    likelihood = np.exp(logs - best).astype(np.float32)[units.codes]
    # Sets of one language to all, in order of the full mixture's proportions; a
    # document takes the next language while that pays for its penalty.
    share, most = mixture(likelihood, units.owner, np.ones((n, k)), units.counts)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    price = PENALTY * 0.5 * np.log(np.maximum(units.counts, 2))
    chosen, reached = mixture(likelihood, units.owner, (rank < 1).astype(float), units.counts)
    # Where even the full mixture would not pay for one more language, none does.
    open_ = (units.counts > 0) & (most - price > reached)
    for size in range(2, k + 1):
        live = np.flatnonzero(open_)
        if not len(live):
            break
        pick = np.isin(units.owner, live)
        renumber = np.full(n, -1)
        renumber[live] = np.arange(len(live))
        more, total = mixture(likelihood[pick], renumber[units.owner[pick]], (rank[live] < size).astype(float), units.counts[live])
        better = total - price[live] > reached[live]
        chosen[live[better]], reached[live[better]] = more[better], total[better]
        open_[live[~better]] = False
    names = np.array(model.names, object)
    top = chosen.argmax(1)
    known = units.counts > 0
    predicted = np.where(known, names[top], UNKNOWN)
    score = np.where(known, np.clip(chosen[np.arange(n), top], 0, 1), 0.0)
    sets = [
        ",".join(f"{names[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0) if ok else ""
        for row, ok in zip(chosen, known, strict=True)
    ]
    return predicted.tolist(), score, sets


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: language, its proportion, and all chosen languages with proportions.

    Null texts and texts without a letter are `und` with score 0. Ties go to the
    language first in the alphabet. Repeated rows are judged each for itself.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language

    def run(batch):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for a, b in slices(texts, 2_000_000):
            names, scores, sets = infer(texts[a:b], held.value)
            yield {"doc_id": ids.slice(a, b - a), "lang_pred": names, "score": scores, "languages": sets}

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PREDICTED)
