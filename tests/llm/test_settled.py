"""Texts whose ids are certain are learned from where they lie; only the rest meets the ids in a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skillgauge.llm import common, dedup, quality

DOC = "doc_id bigint, text string"


def test_certain_rows_and_the_rest(spark, monkeypatch):
    docs = spark.range(-300, 3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.union(spark.createDataFrame([(None, "n"), (7, "again"), (14, None), (8, "unwanted again")], DOC))
    ids = spark.range(-700, 4000, 7).select(F.col("id").alias("doc_id"))
    counts = {}
    for bits in (1 << 24, 1 << 15):
        monkeypatch.setattr(common, "ID_BITS", bits)
        sure, rest = common.settled(common.possible(docs, ids), ids)
        assert sure.columns == rest.columns == docs.columns
        found = sorted(r.doc_id for r in sure.collect())
        assert len(found) == len(set(found)) and all(i % 7 == 0 for i in found) and not {7, 14} & set(found)
        wanted = docs.join(ids, "doc_id", "left_semi")
        both = sure.union(rest.join(ids, "doc_id", "left_semi"))
        assert both.exceptAll(wanted).isEmpty() and wanted.exceptAll(both).isEmpty()
        counts[bits] = rest.count()
    # What repeats; with few bits also what shares one.
    assert 4 <= counts[1 << 24] < 8 <= counts[1 << 15] < 300


def test_target_is_learned_without_moving_the_texts(spark, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 997}" for k in range(1, 61)) for i in range(1, 300)]
    docs = spark.createDataFrame([*enumerate(texts), (3, "b least"), (3, "a least"), (4, None), (None, texts[0])], DOC)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(250)] + [(3, 1), (9, 1), (None, 1)], "doc_id bigint, quality int")
    parts, counted = [], []
    settled, count = common.settled, quality.bucket_counts
    monkeypatch.setattr(quality, "settled", lambda d, i: parts.append(settled(d, i)) or parts[-1])
    monkeypatch.setattr(quality, "bucket_counts", lambda d: counted.append(count(d)) or counted[-1])
    quality.fit(docs, labels)
    (sure, rest), = parts
    assert sure.count() > 50 and rest.count() < 8
    # The same as from all texts that meet the ids, each id by its least text.
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    plain = docs.where(half).join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    assert np.array_equal(counted[1], count(plain)) and counted[1].sum() > 0


def test_sets_of_single_rows_are_made_without_a_join(spark, monkeypatch):
    texts = [" ".join(f"w{(i * k) % 997}" for k in range(1, 30)) for i in range(1, 60)]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[50]), (100, texts[5]), (None, texts[7])], DOC)
    sets = [s.tobytes() for s in dedup.shingle_sets(texts, 4)]
    digest = lambda i: bytearray(dedup.xxhash.xxh3_128_digest(sets[i]))
    # An id that stands for two classes, one whose second text is not wanted, single ones, and one that is not there.
    needed = spark.createDataFrame([(digest(i), i) for i in range(0, 40, 2)] + [(digest(3), 3), (digest(50), 3), (digest(1), 999)], "class binary, doc_id bigint")
    parts = []
    settled = common.settled
    monkeypatch.setattr(dedup, "settled", lambda d, i: parts.append(settled(d, i)) or parts[-1])
    out = {bytes(r["class"]): bytes(r["set"]) for r in dedup.full_sets(docs, needed, 4).collect()}
    assert out == {bytes(digest(i)): sets[i] for i in [*range(0, 40, 2), 3, 50]}
    (sure, rest), = parts
    assert sure.count() == 20 and rest.count() == 2
