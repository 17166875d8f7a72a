"""The language model's steps against plain ones: the same weights, scores and windows, in less time."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from skillgauge.llm import attention, lm
from skillgauge.llm.common import LOWER, Words

ODD = ["", None, " a  b ", "\t\n\x0b\x0c\r x\x1cy \x85 \xa0z", "AÄb É", "\ud800 q \ud800", "a\x00b \x00", " ", "one\ntwo", "b a b"]
N = attention.WINDOW


def plain_gradients(w, x, y, mask):
    """Every layer with all its arrays, each softmax normalised, as the formulas say."""
    width, per = attention.WIDTH, attention.PER_CLASS
    b, n = x.shape
    h = w["embed"][x] + w["place"][:n]
    q, k, v = np.split(h @ w["qkv"], 3, axis=2)
    scores = np.minimum(q @ k.transpose(0, 2, 1) * width**-0.5, 40) + np.triu(np.full((n, n), -1e9, w["embed"].dtype), 1)
    a = np.exp(scores)
    a /= a.sum(2, keepdims=True)
    o = a @ v
    z = h + o @ w["out"]
    u = np.maximum(z @ w["up"] + w["up_bias"], 0)
    r = (z + u @ w["down"]).reshape(-1, width)
    at = np.flatnonzero(mask.ravel())
    ids, m = y.ravel()[at], max(1, mask.sum())
    g = {name: np.zeros_like(value) for name, value in w.items()}

    def back(logits, right):
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(right)), right] -= 1
        return p / m

    d = back(r[at] @ w["cls"] + w["cls_bias"], ids // per)
    g["cls"], g["cls_bias"], dr = r[at].T @ d, d.sum(0), d @ w["cls"].T
    for c in np.unique(ids // per):
        mine = np.flatnonzero(ids // per == c)
        d = back(r[at][mine] @ w["member"][c] + w["member_bias"][c], ids[mine] % per)
        g["member"][c], g["member_bias"][c] = r[at][mine].T @ d, d.sum(0)
        dr[mine] += d @ w["member"][c].T
    full = np.zeros_like(r)
    full[at] = dr
    rows = lambda s: s.reshape(b * n, -1)
    g["down"], du = rows(u).T @ full, (full @ w["down"].T) * (rows(u) > 0)
    g["up"], g["up_bias"], dz = rows(z).T @ du, du.sum(0), full + du @ w["up"].T
    g["out"], do = rows(o).T @ dz, (dz @ w["out"].T).reshape(b, n, width)
    da = do @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(2, keepdims=True)) * np.array(width**-0.5, a.dtype)
    dqkv = rows(np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do], axis=2))
    g["qkv"], dh = rows(h).T @ dqkv, dz + dqkv @ w["qkv"].T
    np.add.at(g["embed"], x.ravel(), dh)
    g["place"][:n] = dh.reshape(b, n, width).sum(0)
    return g


def skewed(n, seed=3):
    """Windows of ids of which few are frequent; the last ones are short."""
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.3, (n, N + 1)) * 7 % attention.IDS, attention.END)
    mask = np.arange(N) < np.where(np.arange(n) < n - 9, N, rng.integers(1, N, n))[:, None]
    return ids[:, :-1], ids[:, 1:], mask


@pytest.mark.parametrize("strength", [1.0, 15.0, 30.0])
def test_gradients_are_the_plain_ones(strength):
    """Also where logits leave the range of exp and scores their bound."""
    x, y, mask = skewed(60)
    w = {k: v.astype(float) * (strength if k in ("embed", "cls", "member") else 1) for k, v in attention.initial(np.bincount(x.ravel(), minlength=attention.IDS)).items()}
    want = plain_gradients(w, x, y, mask)
    got, loss = attention.gradients(w, x, y, mask)
    assert np.isfinite(loss)
    for name, value in want.items():
        assert np.allclose(got[name], value, rtol=1e-6, atol=1e-9 * max(1, np.abs(value).max())), name
    none, loss = attention.gradients(w, x, y, np.zeros_like(mask))
    assert loss == 0 and not any(v.any() for v in none.values())
    # In single precision, as far as rows of scores have an exponential above nothing.
    if strength < 30:
        single, loss = attention.gradients({k: v.astype(np.float32) for k, v in w.items()}, x, y, mask)
        assert np.isfinite(loss)
        for name, value in want.items():
            assert np.allclose(single[name], value, rtol=1e-3, atol=1e-4 * np.abs(value).max()), name


def test_a_step_takes_a_third_of_a_plain_one_at_most():
    x, y, mask = skewed(attention.BATCH)
    w = attention.initial(np.bincount(x.ravel(), minlength=attention.IDS))

    def least(step):
        took = []
        for _ in range(7):
            began = time.thread_time()
            step()
            took.append(time.thread_time() - began)
        return min(took)

    room = attention.Room()
    assert least(lambda: attention.gradients(w, x, y, mask, room)) < 0.3 * least(lambda: plain_gradients(w, x, y, mask))


def test_scores_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    counts = np.array([1, 2, 33, 700, 31, 64, 1500])
    ids = np.minimum(rng.zipf(1.3, counts.sum()) * 7 % attention.IDS, attention.END)
    starts = np.cumsum(counts) - counts
    w = attention.initial(np.bincount(ids, minlength=attention.IDS))
    got = attention.score(w, ids, starts, counts)
    alone = [attention.score(w, ids[a : a + n], np.array([0]), np.array([n]))[0] for a, n in zip(starts, counts, strict=True)]
    assert np.allclose(got, alone, rtol=1e-5)
    monkeypatch.setattr(attention, "ROWS", 100)
    monkeypatch.setattr(attention, "CHUNK", 3)
    assert np.allclose(got, attention.score(w, ids, starts, counts), rtol=1e-5)


def test_training_averages_shards_of_windows(spark, monkeypatch):
    """As many averages as tasks leave them, and the same weights as from each shard in turn."""
    monkeypatch.setattr(lm, "SHARD_WINDOWS", 40)
    x, y, mask = skewed(700)
    rows = [([int(x[i, 0]), *map(int, y[i][mask[i]])], int(i * 2654435761 % 1000003)) for i in range(len(x))]
    windows = spark.createDataFrame(rows, "ids array<smallint>, key bigint").repartition(5)
    shards = len(rows) // (40 * lm.ROUNDS)
    assert shards > 3
    dealt = windows.select("ids", "key", F.pmod("key", F.lit(lm.ROUNDS)).alias("round"), F.pmod(F.xxhash64("key", "ids"), F.lit(shards)).alias("shard")).collect()
    counts = np.bincount([i for ids, _ in rows for i in ids], minlength=attention.IDS)
    assert np.array_equal(lm.id_counts(windows), counts)
    want = attention.initial(counts.astype(float))
    for number in range(lm.ROUNDS):
        trained, sizes = [], []
        for shard in range(shards):
            mine = sorted((r for r in dealt if (r["round"], r["shard"]) == (number, shard)), key=lambda r: r["key"])
            if mine:
                lists = pa.array([r["ids"] for r in mine], pa.list_(pa.int16()))
                trained.append(attention.flat(attention.train(want, *lm.window_arrays(lists))))
                sizes.append(len(mine))
        want = attention.unflat(np.average(trained, axis=0, weights=sizes))
    got = lm.train(windows)
    assert all(np.allclose(got[k], want[k], rtol=1e-5, atol=1e-6) for k in want)


def test_shards_are_whole_across_batches():
    shards, ids = [3, 3, 5, 5, 5, 9], [[i, i] for i in range(6)]
    for cuts in ([0, 6], [0, 1, 6], [0, 4, 4, 6], [0, 2, 5, 6]):
        batches = [
            pa.record_batch({"shard": pa.array(shards[a:b], pa.int64()), "ids": pa.array(ids[a:b], pa.list_(pa.int16()))})
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]
        assert [(s, x.to_pylist()) for s, x in lm.by_shard(batches)] == [(3, ids[:2]), (5, ids[2:5]), (9, ids[5:])]
    assert [*lm.by_shard([])] == []


def test_words_are_those_of_a_split():
    for texts in (ODD, ODD[::-1], [], [""], [None, None], ["x"]):
        for lower in (False, True):
            want = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            want = [(b.translate(LOWER) if lower else b).split() for b in want]
            words = Words(texts, lower)
            assert [[words.vocabulary[c] for c in words.codes[a:b]] for a, b in zip(words.starts, words.ends, strict=True)] == want
            assert words.counts.tolist() == [*map(len, want)] and len(set(words.vocabulary)) == len(words.vocabulary)
