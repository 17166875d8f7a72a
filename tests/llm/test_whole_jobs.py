"""Operators do the whole job: nothing is sampled, capped or hidden behind a better find."""

from __future__ import annotations

import itertools

import numpy as np

from pyspark.sql import functions as F

from skillgauge.llm import attention, licenses, lm, quality, toxicity

DOC = "doc_id bigint, text string"


def test_lm_learns_from_every_subword(spark):
    with open(lm.RANKS, "rb") as f:
        few = b"\n".join(line for line in f.read().splitlines() if int(line.split()[1]) < attention.END)
    texts = [" ".join(f"word{i * j % 97}" for i in range(400)) for j in range(1, 4)] + ["", None, "one"]
    rows = [*enumerate(texts), (90, texts[0]), (91, texts[0])]
    got = lm.training_windows(spark.createDataFrame(rows, DOC), few).collect()
    assert all(2 <= len(r.ids) <= attention.WINDOW + 1 for r in got)
    targets = sorted(i for r in got for i in r.ids[1:])
    streams = [[*itertools.chain.from_iterable(lm.subwords((t or "").encode().split(), few)), attention.END] for _, t in rows]
    assert targets == sorted(itertools.chain.from_iterable(streams))
    # Copies are dealt apart.
    assert len({r.key for r in got}) == len(got)


def test_licenses_find_every_altered_notice_in_a_row():
    forms = ["licenced undr the mit license", "licensed under the mit license", "licensed under teh mit license", "licensed undr the mit licens"]
    for n in (2, 3, 4):
        for row in itertools.permutations(forms, n):
            for between in (" ", " and "):
                text = between.join(row)
                spans = licenses.scan_text(text)["spans"]
                assert [text[s["start"] : s["end"]] for s in spans] == list(row)


def test_toxicity_holds_a_large_vocabulary(spark):
    rng = np.random.default_rng(5)
    made = lambda n, letters: sorted({"".join(rng.choice(list(letters), rng.integers(5, 10))) for _ in range(n)})
    bad, good = made(600, "bdfghjkpquvwxyz"), made(600, "aceilmnorst")
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        words = [*rng.choice(good, 40), *(rng.choice(bad, 40, replace=False) if toxic else [])]
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, DOC)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    of = toxicity.distances(model.toxic, model.ordinary)
    found = {w: of.of(w.encode()) for w in bad}
    # Some words stand in too few documents to be told from chance.
    assert sum(d > 0 for d in found.values()) > 0.9 * len(bad)
    one = spark.createDataFrame([(i, " ".join([*good[:20], w])) for i, w in enumerate(bad)], DOC)
    far = [toxicity.features(of.histogram(t).reshape(1, -1).astype(float), model.ratios)[0, 5] for _, t in one.collect()]
    assert sum(x > 0 for x in far) > 0.9 * len(bad)


def test_quality_learns_from_every_labelled_document(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*rng.choice(words, 60), f"own{i}"])) for i in range(12_400)]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    labels = spark.range(12_400).selectExpr("id AS doc_id", "1 AS quality")
    counted = {}

    def count(texts, real=quality.bucket_counts):
        counted[len(counted)] = real(texts)
        return counted[len(counted) - 1]

    real, quality.bucket_counts = quality.bucket_counts, count
    try:
        model = quality.fit(docs, labels)
    finally:
        quality.bucket_counts = real
    half = spark.range(12_400).where("pmod(xxhash64(id, 1), 2) = 0").count()
    # 61 words and 60 pairs of each document.
    assert counted[0].sum() == 12_400 * 121 and counted[1].sum() == half * 121
    others = quality.score(docs, model).where("pmod(xxhash64(doc_id, 1), 2) = 1")
    below = others.where(f"llr < {model.threshold!r}D").count()
    assert below == int(np.floor((12_400 - half - 1) * quality.TRUSTED_LOSS)) + 1


def test_toxicity_learns_from_every_labelled_document(spark):
    rng = np.random.default_rng(7)
    words = [f"{a}{b}{c}" for a in "klm" for b in "aeiou" for c in "rst"]
    rows = [(i, " ".join([*rng.choice(words, 12), *(["grumblewort"] if i % 100 == 0 else [])])) for i in range(7_000)]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    one = toxicity.known_labels(docs.selectExpr("doc_id", "CAST(doc_id % 100 = 0 AS INT) AS toxic"), F.lit(True))
    assert {r["toxic"]: r["count"] for r in toxicity.labelled(docs, one).groupBy("toxic").count().collect()} == {0: 6_930, 1: 70}
    model = toxicity.fit(docs, one)
    assert toxicity.score(docs, model).where("(predicted = 1) != (doc_id % 100 = 0)").count() == 0
