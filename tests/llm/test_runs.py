"""Runs against the plain search that walks every period through the whole text."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from skillgauge.llm import runs

DOC = "doc_id bigint, text string, runs string, collapsed string, best string, n_words bigint"


def plain(words):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        k = 0
        while k + p < len(words):
            if words[k] != words[k + p]:
                k += 1
                continue
            start = k
            while k + p < len(words) and words[k] == words[k + p]:
                k += 1
            if k + p - start >= max(12, 2 * p):
                found.setdefault((start, k + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    out = list(words)
    if doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            out[i] = words[a + (i - a) % p]
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = plain_plant(doc_id, (text or "").encode().split())
    found = plain(words)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    return doc_id, len(found), *shown, digest("".join(f"{s},{n},{p}\n" for s, n, p in found)), digest(kept)


def texts(rng):
    """Random words over small alphabets, with repeated stretches that break off."""
    for _ in range(150):
        letters = rng.choice(["a", "ab", "abc", "abcdefghijklmnop"])
        words = [rng.choice(letters) for _ in range(rng.randint(0, 150))]
        if rng.random() < 0.4:
            head, unit = words[: rng.randint(0, 20)], words[: rng.randint(1, 30)]
            words = head + unit * rng.randint(1, 6) + unit[: rng.randint(0, 5)] + words[:10]
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "z"
        yield " ".join(words)


def test_equals_plain_search():
    lists = [t.encode().split() for t in texts(random.Random(3))]
    found = runs.runs_of(lists)
    for k, words in enumerate(lists):
        assert [tuple(r) for r in found.get(k, np.zeros((0, 3), int)).tolist()] == plain(words)


def test_agreement_of_all_places():
    rng = random.Random(5)
    codes = np.array([rng.randint(1, 2) for _ in range(60)] + [1] * 40 + [1, 2] * 30)
    sizes = np.array([60, 40, 0, 60])
    ends = np.repeat(np.cumsum(sizes), sizes)
    pairs = [(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if ends[i] == ends[j]]
    i, j = np.array(pairs).T
    got = runs.Agreement(codes, ends).of(i, j)
    for (a, b), n in zip(pairs, got.tolist(), strict=True):
        want = 0
        while b + want < ends[b] and codes[a + want] == codes[b + want]:
            want += 1
        assert n == want


def test_query_equals_plain_search(spark):
    rng = random.Random(9)
    rows = list(enumerate(texts(rng)))
    long = "one two three " * 3000 + "x " + " ".join(str(i * i % 997) for i in range(5000)) + " é 漢 😀" * 900
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "same\x0bsame\x0csame\r" * 9), (904, "a b c" * 30), (None, "x y " * 20), (None, None), (905, long), (905, long), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", "x", "x", 7) for r in rows], DOC)
    got = runs.digests(runs.periodic_runs(docs, runs.planted))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert runs.digests(runs.periodic_runs(docs.limit(0), runs.planted)).collect() == []


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "start " + "go on " * 8 + "end", "x", "x", "x", 7)], DOC)
    (r,) = runs.periodic_runs(docs).collect()
    assert r.collapsed == "start go on end" and [tuple(x) for x in r.runs] == [(1, 16, 2)] and r.n_words == 18


@pytest.mark.parametrize("n", [200_000])
def test_long_texts_do_not_cost_their_square(n):
    assert runs.runs_of([[b"a"] * n])[0].tolist() == [[0, n, 1]]
    assert runs.runs_of([[b"a", b"b"] * (n // 2) + [b"c"]])[0].tolist() == [[0, n, 2]]
