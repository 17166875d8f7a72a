"""Texts that a join by id would drop are left out before the shuffle, and none that it needs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skillgauge.llm import common, dedup, quality, toxicity

DOC = "doc_id bigint, text string"


def test_all_rows_of_the_ids_and_few_others(spark):
    docs = spark.range(-500, 20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).union(spark.createDataFrame([(None, "n"), (7, "again")], DOC))
    ids = spark.range(-700, 20000, 7).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(None,)], "doc_id bigint"))
    out = common.possible(docs, ids)
    assert out.columns == docs.columns
    wanted = docs.join(ids, "doc_id", "left_semi").count()
    assert out.join(ids, "doc_id", "left_semi").count() == wanted
    assert out.count() < 1.02 * wanted and out.where("doc_id IS NULL").isEmpty()
    assert common.possible(docs, ids.limit(0)).isEmpty()


@pytest.mark.parametrize("module", [quality, toxicity, dedup])
def test_learning_shuffles_the_texts_it_needs(spark, module, monkeypatch):
    """Of many documents few are labelled, or have a copy; only their texts meet the ids."""
    seen = []
    possible = common.possible
    monkeypatch.setattr(module, "possible", lambda docs, ids: seen.append(possible(docs, ids)) or seen[-1])
    texts = [" ".join(f"w{(i * k) % 9973}" for k in range(1, 61)) for i in range(1, 400)]
    rows = [*enumerate(texts), (1000, texts[0]), (1001, " ".join(texts[0].split()[:-1] + ["end"]))]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(8)], "doc_id bigint, toxic int, quality int")
    if module is dedup:
        groups = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs).collect()}
        assert [groups[i] for i in (0, 1000, 1001, 5)] == [0, 0, 0, 5]
    else:
        module.fit(docs, labels)
    assert len(seen) == 1 and 0 < seen[0].count() < 20
