"""Outlines of sets: what they leave out is never similar, and they are sent to buckets in place of the sets."""

import numpy as np
from pyspark.sql import functions as F

from skillgauge.llm import dedup

PERCENT = 80


def drawn(rng, n):
    return np.unique(rng.integers(0, 2**64, n, np.uint64))


def pair(rng, n, share):
    """Two sets, about `share` of whose hashes are in both."""
    both, x, y = drawn(rng, int(n * share)), drawn(rng, n - int(n * share)), drawn(rng, n - int(n * share))
    return np.union1d(both, x), np.union1d(both, y)


def row(name, s):
    return {"class": name, "component": name, "size": len(s), "shared": len(s), "outline": dedup.outline(s)}


def is_similar(s, t):
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= PERCENT * (len(s) + len(t) - common)


def test_similar_sets_are_always_candidates_and_unlike_ones_are_not():
    rng = np.random.default_rng(5)
    left = 0
    for n in (1, 2, 7, 40, 255, 256, 300, 3000):
        for share in (0.0, 0.5, 0.7, 0.85, 0.89, 0.9, 0.95, 1.0):
            s, t = pair(rng, n, share)
            found = dedup.Centres([row(b"a", s)]).candidates(row(b"b", t), PERCENT)
            if is_similar(s, t):
                assert found == [(b"a", b"b")]
            left += len(found)
            if n >= 255 and share <= 0.7:
                assert not found
    assert left < 50
    # One set is a little larger than a power of two and its outline twice as long as the other's.
    s = drawn(rng, 270)
    assert dedup.Centres([row(b"a", s), row(b"c", drawn(rng, 265))]).candidates(row(b"b", s[:250]), PERCENT) == [(b"a", b"b")]


def test_crowded_ranges_leave_out_nothing():
    # 40 hashes of one range: the outline cannot count them all.
    s = np.arange(40, dtype=np.uint64)
    for x, y in ((s, s[:36]), (s[:36], s), (s, s + np.uint64(1000))):
        assert dedup.Centres([row(b"a", x)]).candidates(row(b"b", y), PERCENT) == [(b"a", b"b")]


def test_rows_of_a_bucket_hold_outlines_and_give_the_links(spark):
    rng = np.random.default_rng(9)
    sets = {}
    for i in range(12):
        sets[b"a%d" % i], sets[b"b%d" % i] = pair(rng, 200, 0.6 if i % 2 else 0.97)
    table = spark.createDataFrame([(bytearray(k), bytearray(v.tobytes())) for k, v in sets.items()], "class binary, set binary")
    lines = dedup.outlines(table)
    assert lines.columns == ["class", "outline"]
    # An eighth of the set, and its least range.
    assert lines.join(table, "class").where(8 * F.length("outline") > F.length("set")).isEmpty()
    total = sum(map(len, sets.values()))
    members = lines.select(
        F.lit(7).cast("bigint").alias("bucket"), F.lit(24).cast("bigint").alias("n"), F.lit(total).cast("bigint").alias("total"),
        "class", F.col("class").alias("component"), F.lit(200).cast("bigint").alias("size"), F.lit(200).cast("bigint").alias("shared"), "outline",
    )
    near = dedup.candidates_within(members, members, 24, PERCENT)
    found = {(bytes(r.a), bytes(r.b)) for r in dedup.similar(near, table, PERCENT).collect()}
    names = sorted(sets)
    assert found == {(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if is_similar(sets[x], sets[y])}
    assert len(found) >= 6
