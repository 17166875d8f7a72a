"""Fingerprints against windows counted and votes cast one at a time."""

from __future__ import annotations

import base64
import collections
import hashlib
import math

import numpy as np
import pytest

from skillgauge.llm import fingerprints as fp

DOC = "doc_id bigint, text string, part int, head boolean, h string, fingerprint string"
W = fp.WINDOW


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    parts = "ka lo mi ren tas ul vor wen xi zo bra che din fal gos hum é 漢".split()
    return " ".join("".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(n))


def padded(text):
    data = text.encode()
    return data.ljust(W, b"\0") if data else data


def step_of(window: bytes) -> int:
    return (fp.FULL - sum(round(c * math.log2(c) * 2**20) for c in collections.Counter(window).values())) >> fp.STEP_BITS


def steps_of(text):
    data = padded(text)
    return [step_of(data[i : i + W]) for i in range(len(data) - W + 1)]


def rank_of(texts):
    counts = collections.Counter(s for t in texts for s in steps_of(t))
    order = sorted(range(fp.STEPS), key=lambda s: (counts[s], s))
    return {s: r for r, s in enumerate(order)}


def features(text, rank):
    """The windows that win enough votes, each once, in order of their places."""
    steps, data, votes = steps_of(text), padded(text), collections.Counter()
    for at in range(-fp.SPAN + 1, len(steps)) if steps else ():
        seen = range(max(0, at), min(len(steps), at + fp.SPAN))
        votes[min(seen, key=lambda i: (rank[steps[i]], i))] += 1
    found = [data[i : i + W] for i in sorted(votes) if votes[i] >= fp.VOTES]
    return list(dict.fromkeys(found))


def filters(shown: str):
    n, body = shown.split(":")
    bits = np.unpackbits(np.frombuffer(base64.b64decode(body), np.uint8)).reshape(-1, fp.BITS)
    left = int(n)
    return [({int(i) for i in np.flatnonzero(row)}, min(fp.FEATURES, left - k * fp.FEATURES)) for k, row in enumerate(bits)]


def alike(x: str, y: str) -> float:
    a, b = filters(x), filters(y)
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0

    def overlap(s, t):
        if s == t:
            return 1.0
        p, q = len(s), len(t)
        floor = p * q / fp.BITS + 2 * math.sqrt(p * q * (fp.BITS - p) * (fp.BITS - q) / (fp.BITS**2 * (fp.BITS - 1)))
        return max(0.0, (len(s & t) - floor) / (max(p, q) - floor))

    total = sum(w * max(overlap(s, t) for t, _ in b) for s, w in a) + sum(w * max(overlap(s, t) for s, _ in a) for t, w in b)
    return total / sum(w for _, w in a + b)


def rows():
    out = [(i * 3, prose(i, 3 + 37 * i % 170)) for i in range(40)]
    out += [(200, out[7][1]), (201, out[7][1] + " and more"), (202, None), (203, ""), (204, "x"), (205, "a" * 300), (206, "é漢😀 " * 30)]
    return [*out, (9, "another text of the same id " * 3), (None, "no id " * 20), (None, "no id either " * 20), (300, prose(77, 4000))]


def test_equals_plain_version(spark):
    given = rows()
    docs = spark.createDataFrame([(*r, 1, True, "x", "x") for r in given], DOC)
    ranks = fp.fit(docs)
    texts = [t or "" for _, t in given]
    rank = rank_of(texts)
    assert [rank[s] for s in range(fp.STEPS)] == ranks.tolist()
    got = fp.fingerprints(docs, ranks).collect()
    assert len(got) == len(given)
    # Rows of one id are told apart by their length; the order among them is the operator's.
    by = {(r.doc_id, r.n_chars): r for r in got}
    single = [i for i, _ in given if i not in (9, None)]
    down = sorted(single, reverse=True)
    text = {i: t or "" for i, t in given}
    plain = {t: features(t, rank) for t in texts}
    for i, following in zip(down, down[1:], strict=False):
        r = by[i, len(text[i])]
        assert int(r.fingerprint.split(":")[0]) == len(plain[text[i]])
        if any(following < j < i for j, _ in given if j is not None):
            continue
        half = len(text[i]) // 2
        changed = text[i][: len(text[i]) - half] + text[following][:half]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert int(r.edited_fingerprint.split(":")[0]) == len(features(changed, rank))
        assert r.near_edited == pytest.approx(alike(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(alike(r.fingerprint, by[following, len(text[following])].fingerprint))
    assert by[200, len(text[200])].fingerprint == by[21, len(text[21])].fingerprint
    assert by[201, len(text[201])].near_next > 0.8
    # The last row in order goes on with the first.
    last = [r for r in got if r.doc_id is None and r.edited_sha256 in {hashlib.sha256(fp.edited(t, text[300]).encode()).hexdigest() for i, t in given if i is None}]
    assert len(last) == 1


@pytest.mark.parametrize("text", [None, "", "x", prose(3, 60)])
def test_single_row_is_its_own_next(spark, text):
    docs = spark.createDataFrame([(1, text, 1, True, "x", "x")], DOC)
    (r,) = fp.fingerprints(docs, fp.fit(docs)).collect()
    assert r.n_chars == len(text or "") and r.near_next == 1.0 and 0 <= r.near_edited <= 1
    assert fp.fingerprints(docs.limit(0), fp.fit(docs.limit(0))).collect() == []


def test_more_ranges_than_rows_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i // 3, f"text number {i // 6} " * 9, 1, True, "x", "x") for i in range(30)], DOC)
    got = fp.fingerprints(docs, fp.fit(docs)).collect()
    assert sorted(r.doc_id for r in got) == [i // 3 for i in range(30)]
    # In descending order five texts follow each other, six rows each: five rows have another text behind them.
    assert sum(r.near_next == 1.0 for r in got) == 25
