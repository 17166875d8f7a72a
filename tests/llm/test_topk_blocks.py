"""A pair of blocks is searched for many queries at once, with the same results as looking at every candidate."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from skillgauge.llm import topk


def blocks(v, ids, asks, pivots):
    square = float((v * v).sum(1).max())
    full = topk.with_tail(v, square)
    frame = lambda at, rows: pd.DataFrame(
        {"vec_id": ids[at], "v": list(v[at].astype(np.int64)), "pivots": list(topk.distances(rows, full[:pivots]))}
    )
    return frame(asks, np.column_stack([v[asks], np.zeros(len(asks))])), frame(np.arange(len(v)), full), square


@pytest.mark.parametrize(("spread", "dim", "pivots", "copies"), [(64, 16, 8, 1), (2, 3, 5, 1), (3, 4, 0, 1), (9, 6, 4, 3), (0, 2, 1, 1)])
def test_best_of_block_is_exact_and_ranks_queries_together(monkeypatch, spread, dim, pivots, copies):
    rng = np.random.default_rng(dim)
    v = rng.integers(-spread, spread + 1, (900, dim)).astype(float)
    ids, asks = rng.permutation(900) // copies, np.arange(0, 900, 3)
    if copies > 1:  # a query id is asked once
        asks = asks[np.unique(ids[asks], return_index=True)[1]]
    queries, candidates, square = blocks(v, ids, asks, pivots)
    calls = []
    sort = np.lexsort
    monkeypatch.setattr(topk.np, "lexsort", lambda keys: calls.append(1) or sort(keys))
    monkeypatch.setattr(topk, "STEP", 64)
    out = topk.best_of_block(queries, candidates, 5, square)
    assert len(calls) < 10 < len(queries)
    got = {q: list(zip(-part["score"], part["vec_id"], strict=True)) for q, part in out.groupby("query_id")}
    for at in asks:
        scores = (v @ v[at]).astype(int)
        wanted = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != ids[at])[:5]
        assert sorted(got[ids[at]]) == wanted


def test_fewer_candidates_than_wanted():
    v = np.array([[1.0, 2.0], [3.0, -1.0], [0.0, 0.0]])
    queries, candidates, square = blocks(v, np.array([5, 6, 7]), np.array([0]), 2)
    out = topk.best_of_block(queries, candidates, 20, square)
    assert sorted(zip(out["vec_id"], out["score"], strict=True)) == [(6, 1), (7, 0)]
    assert topk.best_of_block(queries, candidates.head(1), 20, square).empty


def test_tiles_far_from_all_queries_are_left_out(monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(-60, 61, (20, 24))
    v = (centres.repeat(100, 0) + rng.integers(-1, 2, (2000, 24))).astype(float)
    queries, candidates, square = blocks(v, np.arange(2000), np.arange(0, 100, 20), 30)
    seen = []
    rint = np.rint
    monkeypatch.setattr(topk.np, "rint", lambda x: seen.append(x.size) or rint(x))
    monkeypatch.setattr(topk, "STEP", 50)
    topk.best_of_block(queries, candidates, 5, square)
    assert 0 < sum(seen) < 0.8 * len(queries) * len(v)
