"""The manifest against trees built and folded by hand."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest

from skillgauge.llm import manifest

DOC = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, tree bigint, path string"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def joined(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return joined("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([joined(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain(rows):
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: tree_of([g[2] for g in sorted(groups[n], key=lambda g: g[:3])]) for n in names}
    top = tree_of([trees[n][-1][0] for n in names])
    for k, name in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[name], key=lambda g: g[:3])):
            touched = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            now = leaf_of((*row[:4], row[4].encode().translate(LOWER).decode())) if touched else leaf
            siblings = []
            for levels, at in ((trees[name], i), (top, k)):
                for level in levels[:-1]:
                    first = at // 8 * 8
                    left, right = level[first:at], level[at + 1 : first + 8]
                    siblings += left + right
                    now = joined([*left, now, *right])
                    at //= 8
            yield row[0], leaf, trees[name][-1][0], top[-1][0], joined(siblings), now, now == top[-1][0]


def rows(n):
    out = [(i * 7 % n, f"src{i % 3}", ("en", "de", None, "ä", "zz")[i % 5 if i < 40 else 0], i, f"Text {i} É") for i in range(n)]
    out += [(3, None, "en", None, None), (3, None, "en", None, None), (None, "s", "en", 1, "NULL id"), (None, None, None, None, None)]
    return [*out, (n + 1, "s", "alone", 0, ""), (n + 2, "s", "fr", 4, "LONG " * 50_000), (n + 3, "s", "EN", 1, "漢😀 A")]


@pytest.mark.parametrize("n", [0, 9, 600])
def test_equals_trees_by_hand(spark, n):
    given = rows(n) if n else []
    docs = spark.createDataFrame([(*r, "x", 1, "x") for r in given], DOC)
    got = manifest.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(given), key=repr)


def test_many_languages_and_a_single_row(spark):
    for given in ([(1, "s", f"lang{i}", i, "Same Text") for i in range(70)], [(6, None, None, None, "ONE")]):
        got = manifest.manifest(spark.createDataFrame([(*r, "x", 1, "x") for r in given], DOC)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(plain(given), key=repr)


def test_only_changed_texts_fail(spark):
    given = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(100)]
    got = {r.doc_id: r for r in manifest.manifest(spark.createDataFrame([(*r, "x", 1, "x") for r in given], DOC)).collect()}
    for i, r in got.items():
        assert r.verified == (i % 2 == 0 or zlib.crc32(str(i).encode()) % 3 != 0)


def test_sql_equals_trees_by_hand():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows(90))
    assert sorted(con.execute(manifest.SQL).fetchall(), key=repr) == sorted(plain(rows(90)), key=repr)
