"""The pipeline over the small tables, stage by stage, against plain versions of what each stage decides."""

from __future__ import annotations

import collections
import os

import pytest
from test_operators import plain_quality, plain_secrets, shingles

import corpus_pipeline
from skillgauge.llm.common import stored, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        out[name] = (before, docs.collect(), docs.columns)
    return out


def test_stages_keep_the_columns_and_order(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "secrets", "packing"]
    columns = table(spark, SF, "documents").columns
    assert all(stages[n][2] == columns for n in ("toxicity", "quality", "near_dedup", "secrets"))


def test_filters_take_rows_only(stages):
    for name in ("toxicity", "quality"):
        before, after, _ = stages[name]
        assert all(before[r.doc_id] == r for r in after) and len(after) > 0.6 * len(before)
    before, after, _ = stages["quality"]
    kept = {r.doc_id for r in after}
    for doc_id, row in before.items():
        n, *_, repeated = plain_quality(row.text)
        if n < 50 or 100 * repeated > 50 * n:
            assert doc_id not in kept


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages["near_dedup"]
    sets = {i: shingles(r.text, 5) for i, r in before.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in after) == [i for i in ids if root(i) == i]


def test_secrets_go_and_packing_is_whole(stages):
    before, after, _ = stages["secrets"]
    assert {r.doc_id for r in after} == set(before)
    for r in after:
        assert plain_secrets(r.text) == [] and r.n_chars == len(r.text)
        if not plain_secrets(before[r.doc_id].text) and "[SECRET]" not in r.text:
            assert r.text == before[r.doc_id].text
    before, placed, _ = stages["packing"]
    filled = collections.Counter()
    for r in placed:
        filled[r.doc_id] += r.length
    assert filled == {i: len(r.text.encode()) + 1 for i, r in before.items()}
