"""A Merkle manifest of a data set, its nodes labelled by nested intervals.

Every row is a leaf; the leaves of a language make a tree, the trees' roots another.
A node carries the interval of the leaf ranks that it covers. At each level the
nodes fall into buckets of the width of the next level, and joining a bucket's
nodes with the node that contains their intervals attaches ancestors, from the root
down. What a parent's interval has left and right of a child's is where the child's
siblings lie: with them a changed leaf is folded up to the root again.

All of it is joins and sums of narrow rows: texts are read once, to be hashed. A
bucket has at most `FAN` nodes and one parent, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .order import ranked

# How many consecutive nodes make the next one, and the fields of a leaf in their order.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:binary,right:binary>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*[part(fields[name].cast("string")) for name in FIELDS]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and changed (null where no tampering touches the row) of every document, digests as bytes.

    Tampering lower-cases A-Z in the text where 3 divides crc32 of the id; rows without an id are left alone.
    """
    fields = {name: F.col(name) for name in FIELDS}
    lowered = fields | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    chosen = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & F.col("text").isNotNull()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.unhex(leaf_digest(fields)).alias("leaf"),
        F.when(chosen, F.unhex(leaf_digest(lowered))).alias("changed"),
    )


def bucket(level: int) -> Column:
    """Which node of `level` an interval lies in, counted within its tree."""
    return F.floor((F.col("lo") - F.col("tree")) / F.lit(FAN**level))


def grown(bottom: DataFrame, longest: int, name: str) -> list[DataFrame]:
    """All levels of trees over `bottom` (tree, n, lo, hi, digest), from the leaves up.

    `tree` is the rank of a tree's first leaf and n its number of leaves, `longest`
    the greatest n. Nodes carry their children: lo, hi and digest of each. A node that covers
    its whole tree is the root and has no parent.
    """
    levels, level = [bottom], 0
    while FAN**level < longest:
        level += 1
        below = levels[-1].where(F.col("hi") - F.col("lo") < F.col("n"))
        children = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        nodes = below.groupBy("tree", "n", bucket(level).alias("at")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), children.alias("children"))
        joined = F.array_join(F.transform("children", lambda c: hexed(c["digest"])), "")
        levels.append(stored(nodes.select("tree", "n", "lo", "hi", F.unhex(digest(joined)).alias("digest"), "children"), name))
    return levels


def run_of(children: Column, keep) -> Column:
    """Digests of those children whose interval `keep` takes, one behind the other."""
    return F.unhex(F.array_join(F.transform(F.filter(children, keep), lambda c: F.hex(c["digest"])), ""))


def attached(below: DataFrame, above: DataFrame, level: int, carried: list[str]) -> DataFrame:
    """`below` with the path and the `carried` columns of the node of `level` that contains each.

    The path of siblings grows by those of the parent's children that lie in the
    parent's interval before and behind the child's own.
    """
    parent = above.select("tree", bucket(level).alias("at"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("children").alias("p_children"), "path", *carried)
    inside = (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
    both = below.withColumn("at", bucket(level)).join(parent, ["tree", "at"]).where(inside)
    left = run_of(F.col("p_children"), lambda c: c["hi"] <= F.col("lo"))
    right = run_of(F.col("p_children"), lambda c: c["lo"] >= F.col("hi"))
    step = F.array(F.struct(left.alias("left"), right.alias("right"))).cast(PATH)
    return both.select(*below.columns, F.concat(step, "path").alias("path"), *carried)


def with_paths(levels: list[DataFrame], roots: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves of `levels` with the siblings on the way to the root of all, lowest first.

    `roots` has tree, path (above the tree's root) and the `carried` columns.
    """
    above = None
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level]
        whole = F.col("hi") - F.col("lo") == F.col("n")
        here = nodes.where(whole).join(roots, "tree").select(*nodes.columns, "path", *carried)
        if above is not None:
            here = here.unionByName(attached(nodes.where(~whole), above, level + 1, carried))
        above = here
    return above


def folded(path: Column, start: Column) -> Column:
    """The root's digest that `start` (hexadecimal) leads to with the siblings of `path`."""
    return F.aggregate(path, start, lambda acc, step: digest(F.concat(hexed(step["left"]), acc, hexed(step["right"]))))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests in hexadecimal.

    Rows without an id come first in their language and are not tampered with; rows
    with the same id follow each other by their leaf's digest. Equal rows have equal
    leaves and places next to each other. Rows without a language make a tree of their own, which comes first. An empty
    table has no rows. Columns other than the five fields are ignored.
    """
    flat = stored(leaves(docs), "leaves")
    order = ranked(flat, "lang", "doc_id", "leaf", rank="lo", name="leaf-ranks")
    trees = order.groupBy("lang").agg(F.min("lo").alias("tree"), F.count("*").alias("n"))
    trees = stored(trees.withColumnRenamed("lang", "t_lang"), "trees")
    labelled = order.join(trees, F.col("lang").eqNullSafe(F.col("t_lang"))).select(
        "tree", "n", "lo", (F.col("lo") + 1).alias("hi"), F.col("leaf").alias("digest"), "doc_id", "changed"
    )
    labelled = stored(labelled, "labelled")
    longest, many = trees.agg(F.max("n"), F.count("*")).first()
    levels = grown(labelled, longest or 0, "nodes")

    whole = F.col("hi") - F.col("lo") == F.col("n")
    subroots = [level.where(whole).select(F.col("tree").alias("of"), "digest") for level in levels]
    first, *rest = subroots
    for more in rest:
        first = first.union(more)
    tops = ranked(first, "of", rank="lo", name="subroots")
    tops = stored(tops.select(F.lit(0).cast("bigint").alias("tree"), F.lit(many).alias("n"), "lo", (F.col("lo") + 1).alias("hi"), "digest", "of"), "tops")
    upper = grown(tops, many, "tops")
    root = upper[-1].where(whole).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = with_paths(upper, root, ["root"]).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root")

    found = with_paths(levels, stored(above, "subroot-paths"), ["subroot", "root"])
    siblings = F.transform("path", lambda step: F.concat(hexed(step["left"]), hexed(step["right"])))
    out = found.select(
        "doc_id",
        hexed(F.col("digest")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        digest(F.array_join(siblings, "")).alias("proof_sha256"),
        folded(F.col("path"), hexed(F.coalesce("changed", "digest"))).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# The same in SQL, straight from the definition: recursion over levels, siblings by number.
SQL = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
altered AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND xor(list_reduce(
      list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(list_extract(t, (xor(c, b) & 255) + 1), c >> 8)), 4294967295) % 3 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents, crc),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS started
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM altered) AS f),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, r AS spot, n, leaf AS digest FROM leaves
  UNION ALL SELECT lang, level + 1, spot // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY spot)) FROM nodes WHERE n > 1 GROUP BY lang, level, spot // 8, n),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, k AS spot, n, subroot AS digest FROM subroots
  UNION ALL SELECT level + 1, spot // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY spot)) FROM tops WHERE n > 1 GROUP BY level, spot // 8, n),
steps AS (
  SELECT c.lang, c.level, c.spot, coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (WHERE s.spot < c.spot), '') AS l,
    coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (WHERE s.spot > c.spot), '') AS r
  FROM nodes AS c JOIN nodes AS s ON c.lang IS NOT DISTINCT FROM s.lang AND c.level = s.level AND c.spot // 8 = s.spot // 8 WHERE c.n > 1 GROUP BY c.lang, c.level, c.spot),
upper_steps AS (
  SELECT c.level, c.spot, coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (WHERE s.spot < c.spot), '') AS l,
    coalesce(string_agg(s.digest, '' ORDER BY s.spot) FILTER (WHERE s.spot > c.spot), '') AS r
  FROM tops AS c JOIN tops AS s ON c.level = s.level AND c.spot // 8 = s.spot // 8 WHERE c.n > 1 GROUP BY c.level, c.spot),
below AS (
  SELECT v.lang, v.r AS place, list({'l': s.l, 'd': '', 'r': s.r} ORDER BY s.level) AS path
  FROM leaves AS v JOIN steps AS s ON v.lang IS NOT DISTINCT FROM s.lang AND s.spot = v.r // CAST(8 ** s.level AS BIGINT) GROUP BY v.lang, v.r),
above AS (
  SELECT v.lang, list({'l': s.l, 'd': '', 'r': s.r} ORDER BY s.level) AS path
  FROM subroots AS v JOIN upper_steps AS s ON s.spot = v.k // CAST(8 ** s.level AS BIGINT) GROUP BY v.lang),
whole AS (
  SELECT v.doc_id, v.leaf, v.started, t.subroot, (SELECT digest FROM tops WHERE n = 1) AS root, list_concat(coalesce(b.path, []), coalesce(a.path, [])) AS path
  FROM leaves AS v JOIN subroots AS t ON v.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN below AS b ON v.lang IS NOT DISTINCT FROM b.lang AND v.r = b.place LEFT JOIN above AS a ON v.lang IS NOT DISTINCT FROM a.lang),
done AS (
  SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda s: s.l || s.r)), 'string_agg', '')) AS proof_sha256,
    list_reduce(list_prepend({'l': '', 'd': started, 'r': ''}, path), lambda a, s: {'l': '', 'd': sha256(s.l || a.d || s.r), 'r': ''}).d AS folded_root FROM whole)
SELECT *, folded_root = root AS verified FROM done"""
