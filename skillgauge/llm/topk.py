"""Exact top-k search by inner product with a table of pivot distances.

Each vector gets one more component that makes all candidates equally long, so
that a larger inner product is a smaller distance. Distances of every vector to
many pivots are worked out once; by the triangle inequality the largest
difference of two vectors' pivot distances is a lower bound of their distance.
Candidates with the same nearest pivot stand side by side in tiles, which are
looked at in the order of their bound until none that is left can beat the k-th
best so far; many queries meet a tile in one product of matrices.

Queries and candidates are cut into blocks. Each pair of blocks is one group: its
k best per query go on, and the best of those are the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partition_map, stored

K = 20
PIVOTS = 48
# Pivots are chosen from at most this many vectors.
PIVOT_SAMPLE = 2000
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
# Candidates of a tile, which have one bound and are evaluated together, and queries that meet a tile at a time.
STEP = 256
CHUNK = 128
# Slack for rounding in distances, which are of whole numbers squared.
SLACK = 1e-6

RESULT = "query_id bigint, vec_id bigint, score bigint"
TABLE = "vec_id bigint, is_query boolean, dim int, v array<bigint>, pivots array<double>"


@dataclass(frozen=True)
class Pivots:
    """For each dimension the pivots (with their last component) and the square of the common length."""

    points: dict[int, np.ndarray]
    square: dict[int, float]


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v (whole numbers), dim, square; without null ids and vectors that are null, empty or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    good = good.where(F.forall("embedding", finite))
    out = good.select(F.col("vec_id").cast("bigint").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"))
    square = F.aggregate("v", F.lit(0).cast("bigint"), lambda acc, x: acc + x * x)
    return out.select("vec_id", "v", F.size("v").alias("dim"), square.alias("square"))


def choose(rows: DataFrame) -> Pivots:
    """Pivots far from each other (each the sampled vector farthest from those before), for each dimension.

    The sample has at most PIVOT_SAMPLE vectors, lowest id hashes first.
    """
    square = {r["dim"]: float(r["m"]) for r in rows.groupBy("dim").agg(F.max("square").alias("m")).collect()}
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toPandas()["v"]
    points = {}
    for dim, longest in square.items():
        mine = np.array([v for v in sample if len(v) == dim], float).reshape(-1, dim)
        full = with_tail(mine, longest)
        if not len(full):
            points[dim] = full
            continue
        chosen = [0]
        far = np.linalg.norm(full - full[0], axis=1)
        while len(chosen) < min(PIVOTS, len(full)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(full - full[chosen[-1]], axis=1))
        points[dim] = full[chosen]
    return Pivots(points, square)


def with_tail(v: np.ndarray, square: float) -> np.ndarray:
    """Candidates with the component that makes them all of length sqrt(square)."""
    return np.column_stack([v, np.sqrt(np.maximum(square - (v * v).sum(1), 0))])


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (v @ pivots.T)
    return np.sqrt(np.maximum(squared, 0))


def pivot_table(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """Rows with their distances to all pivots, as candidate and, where they are queries, as query (last component 0)."""

    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for dim, part in frame.groupby("dim"):
                v = np.array(part["v"].tolist(), float).reshape(len(part), dim)
                asks = part["is_query"].to_numpy(bool)
                tail = np.where(asks[:, None], np.column_stack([v, np.zeros(len(v))]), with_tail(v, pivots.square[dim]))
                yield {
                    "vec_id": part["vec_id"].to_numpy(),
                    "is_query": asks,
                    "dim": part["dim"].to_numpy(),
                    "v": part["v"].tolist(),
                    "pivots": distances(tail, pivots.points[dim]).tolist(),
                }

    return partition_map(rows.select("vec_id", "is_query", "dim", "v"), run, TABLE)


def tiles_of(pivots: np.ndarray) -> np.ndarray:
    """Row numbers in an order that puts rows with the same nearest pivot, and like distances to it, side by side."""
    if not pivots.shape[1]:
        return np.arange(len(pivots))
    return np.lexsort((pivots.min(1), pivots.argmin(1)))


def most_of_tiles(q: np.ndarray, qp: np.ndarray, vp: np.ndarray, starts: np.ndarray, square: float) -> np.ndarray:
    """For each query and tile the most that an inner product can be: sums of whole numbers, so rounded down.

    A tile's rows have pivot distances between a least and a largest, and how far the query's own
    distance is outside of them is a lower bound of its distance to each of them.
    """
    bound = np.zeros((len(qp), len(starts)))
    if qp.shape[1]:
        low, high = np.minimum.reduceat(vp, starts), np.maximum.reduceat(vp, starts)
        for p in range(qp.shape[1]):
            np.maximum(bound, low[:, p] - qp[:, p, None], out=bound)
            np.maximum(bound, qp[:, p, None] - high[:, p], out=bound)
    return np.floor(((q * q).sum(1)[:, None] + square - np.maximum(bound - SLACK, 0) ** 2) / 2 + SLACK)


def best_of_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, square: float) -> pd.DataFrame:
    """The k best candidates of each query in one pair of blocks, evaluated tile by tile in bound order until exact."""
    q, v, qp, vp = (np.array(f[c].tolist(), float).reshape(len(f), -1) for c in ("v", "pivots") for f in (queries, candidates))
    own, ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    # Like queries look at like tiles.
    asks, gives = tiles_of(qp), tiles_of(vp)
    q, qp, own, v, vp, ids = q[asks], qp[asks], own[asks], v[gives], vp[gives], ids[gives]
    starts = np.arange(0, len(v), STEP)
    out = []
    for a in range(0, len(q), CHUNK):
        mine = q[a : a + CHUNK]
        most = most_of_tiles(mine, qp[a : a + CHUNK], vp, starts, square)
        scores = np.full((len(mine), len(v)), -np.inf)  # of the tiles in the order they are looked at
        seen = np.zeros(len(v), np.int64)
        least, used, look = np.full(len(mine), -np.inf), 0, k
        for tile in np.argsort(-most.max(0), kind="stable").tolist():
            open_ = np.flatnonzero(most[:, tile] >= least)
            if not len(open_):
                continue
            rows = slice(starts[tile], starts[tile] + STEP)
            n = len(ids[rows])
            part = np.rint(mine[open_] @ v[rows].T)
            part[own[a + open_][:, None] == ids[rows][None, :]] = -np.inf
            scores[open_, used : used + n] = part
            seen[used : used + n] = ids[rows]
            used += n
            if used >= look:
                # The k-th best so far, looked up again when twice as much has been seen.
                least, look = np.partition(scores[:, :used], used - k, axis=1)[:, used - k], 2 * used
        scores = scores[:, :used]
        if used > k:
            least = np.partition(scores, used - k, axis=1)[:, used - k]
        else:
            least = np.full(len(mine), -np.inf)
        row, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        value, found = scores[row, at], seen[at]
        order = np.lexsort((found, -value, row))
        row, value, found = row[order], value[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        out.append((own[a + row[keep]], found[keep], value[keep]))
    return pd.DataFrame({name: np.concatenate(part).astype(np.int64) for name, part in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best by inner product of whole numbers floor(scale * x), ties to the smaller id.

    `is_query` says which rows are queries, by vec_id. Rows with a null id or a
    vector that is null, empty or holds null or non-finite components take no
    part; vectors of different lengths are not compared. Rows with the query's own
    id are no candidates. Repeated rows are candidates each; a query id that occurs
    in several rows is answered once, by its first vector in sorted order.
    """
    rows = stored(usable(vectors, scale), "vectors")
    count = rows.count()
    spark = vectors.sparkSession
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = choose(rows)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("first")).select("vec_id", "first.v", "first.dim")
    n_queries = asked.count()
    query_blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    candidate_blocks = math.ceil(count / CANDIDATE_BLOCK)
    every = pivot_table(
        asked.withColumn("is_query", F.lit(True)).unionByName(rows.select("vec_id", "v", "dim").withColumn("is_query", F.lit(False))), pivots
    )
    every = stored(every, "pivot-table")
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Each row of one side meets each block of the other once; groups hold one block of each.
    asks = every.where("is_query").select("*", block(query_blocks, 1).alias("qb"), numbers(candidate_blocks).alias("cb"))
    gives = every.where("NOT is_query").select("*", block(candidate_blocks, 2).alias("cb"), numbers(query_blocks).alias("qb"))
    squares = pivots.square

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return best_of_block(queries, candidates, k, squares[int(queries["dim"].iloc[0])])

    keys = ("dim", "qb", "cb")
    found = asks.groupBy(*keys).cogroup(gives.groupBy(*keys)).applyInPandas(search, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # k rows of each candidate block per query.
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
