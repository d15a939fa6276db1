"""Exact top-k inner products by columnar branch-and-bound.

Vectors become integers and are dealt into blocks by a row number.  A cell of the
grid holds one block of queries and one of candidates, both bounded, in vertical
layout (a row for each dimension, the heaviest dimensions first).  Scores accumulate
one block of dimensions at a time for a tile of queries; what the dimensions to come
can still add is at most the product of the remaining norms, so candidates whose
bound is below what every query of the tile surely reaches are compacted away.

A first pass gives each query the score it surely reaches: the k-th best among
``SEEDS`` vectors of large norm.  All cells start from it.  Each cell answers with
its k best, and a window keeps the k best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

K = 20
SCALE = 64
QUERY_EVERY = 20
#: Rows of a cell, in queries and in candidates.
QUERIES, CANDIDATES = 8192, 16_384
#: Groups of candidates there are at least (of 256 rows or more), to have work for all cores.
GROUPS = 32
#: Vectors of large norm, at most, that give the first bounds; the driver sends so many to all tasks.
SEEDS = 2048
#: Dimensions that are added between two bounds, and queries that share their candidates.
DIMENSIONS, TILE = 16, 64
#: Below this, sums of products are exact in double precision.
EXACT = 2**53


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and v, floor(SCALE * x) of each component; without rows that take no part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    return known.where(~bad).select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE)).alias("v"))


def matrix(vectors: list[np.ndarray], size: int) -> np.ndarray:
    """Columns are vectors; shorter ones end in zeros."""
    out = np.zeros((size, len(vectors)))
    if len({len(v) for v in vectors}) == 1 and len(vectors[0]) == size:
        out[:] = np.stack(vectors, axis=1)
        return out
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def best(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int = K, reached: np.ndarray | None = None, block: int = DIMENSIONS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best candidates in a cell but for its own row, as (query's place, their places, scores).

    ``q`` and ``c`` have a row for each dimension; ``reached``: a score for each query
    that k candidates of the whole table have, below which nothing is needed.
    """
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")
    q, c = q[order], np.ascontiguousarray(c[order])
    size, many = c.shape
    ends = [*range(block, size, block), size]
    # Norms of what is left after each block of dimensions, a hair larger than rounding can lose.
    left = lambda m: [np.sqrt((m[e:] * m[e:]).sum(axis=0)) * (1 + 1e-12) for e in ends]
    q_left, c_left = left(q), left(c)
    place = {int(r): j for j, r in enumerate(c_rows)}
    seed = np.argsort(-(c * c).sum(axis=0), kind="stable")[: 4 * k]
    for a in range(0, q.shape[1], TILE):
        tile = np.ascontiguousarray(q[:, a : a + TILE].T)
        least = np.full(len(tile), -np.inf) if reached is None else reached[a : a + TILE].astype(float)
        own = [(i, place[int(r)]) for i, r in enumerate(q_rows[a : a + TILE]) if int(r) in place]
        if len(seed) > k:
            known = tile @ c[:, seed]
            for i, j in own:
                known[i, seed == j] = -np.inf
            least = np.maximum(least, np.partition(known, -k, axis=1)[:, -k])
        alive, score = np.arange(many), tile[:, : ends[0]] @ c[: ends[0]]
        for i, j in own:
            score[i, j] = -np.inf
        for n in range(1, len(ends)):
            kept = (score + np.outer(q_left[n - 1][a : a + TILE], c_left[n - 1][alive]) >= least[:, None]).any(axis=0)
            if kept.mean() < 0.8:
                alive, score = alive[kept], score[:, kept]
            part = c[ends[n - 1] : ends[n]]
            score += tile[:, ends[n - 1] : ends[n]] @ (part if len(alive) == many else part[:, alive])
        good = (score >= least[:, None]) & (score > -np.inf)
        for i in range(len(tile)):
            found = np.flatnonzero(good[i])
            s = score[i, found]
            if len(s) > 4 * k:
                high = s >= np.partition(s, -k)[-k]
                found, s = found[high], s[high]
            found = alive[found]
            top = np.lexsort((c_rows[found], c_ids[found], -s))[:k]
            yield a + i, found[top], s[top]


def exact(q: list[np.ndarray], q_rows: np.ndarray, c: list[np.ndarray], c_rows: np.ndarray, c_ids: np.ndarray, k: int = K) -> Iterator[tuple[int, list[int], list[int]]]:
    """As :func:`best`, in Python's integers: for components so large that doubles would round."""
    for at, (v, own) in enumerate(zip(q, q_rows.tolist())):
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w)), int(c_ids[j]), j) for j, w in enumerate(c) if c_rows[j] != own)[:k]
        yield at, [j for *_, j in scored], [-s for s, *_ in scored]


def exactly(q: list[np.ndarray], c: list[np.ndarray]) -> bool:
    """Whether doubles hold all products, squares and their sums."""
    size = max(1, max(map(len, q)), max(map(len, c)))
    top = lambda m: max([0, *(max(abs(int(x.max())), abs(int(x.min()))) for x in m if len(x))])
    a, b = top(q), top(c)
    return size * max(1, a) * max(1, b) < EXACT and size * max(a, b) ** 2 < EXACT


def cell(queries: pd.DataFrame, candidates: pd.DataFrame, k: int = K) -> pd.DataFrame:
    """The k best of each query's row in one cell: (query_row, query_id, row, vec_id, score)."""
    names = ["query_row", "query_id", "row", "vec_id", "score"]
    rows: list[tuple] = []
    if len(queries) and len(candidates):
        q, c = list(queries["v"]), list(candidates["v"])
        q_rows, c_rows = queries["row"].to_numpy(np.int64), candidates["row"].to_numpy(np.int64)
        q_ids, c_ids = queries["vec_id"].to_numpy(np.int64), candidates["vec_id"].to_numpy(np.int64)
        if exactly(q, c):
            size = max(1, max(map(len, q)), max(map(len, c)))
            reached = queries["reached"].to_numpy(float, na_value=-np.inf) if "reached" in queries else None
            found = best(matrix(q, size), q_rows, matrix(c, size), c_rows, c_ids, k, reached)
        else:
            found = exact(q, q_rows, c, c_rows, c_ids, k)
        lowest, highest = -(2**63), 2**63 - 1
        for at, places, scores in found:
            rows += [(q_rows[at], q_ids[at], c_rows[j], c_ids[j], min(max(int(s), lowest), highest)) for j, s in zip(places, scores)]
    return pd.DataFrame(rows, columns=names).astype("int64")


def first_bounds(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Adds ``reached`` to ``queries``: the k-th best score among SEEDS large vectors, null where there are too few.

    The rows are dealt by a hash into SEEDS groups, and each gives its largest.
    """
    mass = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dealt = rows.select("row", "v", mass.alias("mass"), F.pmod(F.xxhash64(F.lit("seeds"), "row"), F.lit(SEEDS)).alias("group"))
    top = dealt.groupBy("group").agg(F.max("mass").alias("mass"))  # at most SEEDS rows, here and below
    ties = dealt.join(F.broadcast(top), ["group", "mass"]).groupBy("group").agg(F.min("row").alias("row"))
    seeds = rows.join(F.broadcast(ties), "row").select("row", "v").collect()
    shared = rows.sparkSession.sparkContext.broadcast(([r["row"] for r in seeds], [r["v"] for r in seeds]))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_rows, vectors = np.array(shared.value[0]), [np.array(v) for v in shared.value[1]]
        for batch in batches:
            q = [np.array(v) for v in batch.column("v").to_pylist()]
            reached = [None] * len(q)
            if q and len(vectors) > k and exactly(q, vectors):
                size = max(1, max(map(len, q)), max(map(len, vectors)))
                score = matrix(q, size).T @ matrix(vectors, size)
                score[batch.column("row").to_numpy()[:, None] == seed_rows[None, :]] = -np.inf
                reached = np.partition(score, -k, axis=1)[:, -k].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reached, pa.float64())], names=[*batch.schema.names, "reached"])

    return queries.mapInArrow(bounds, "row long, vec_id long, v array<long>, reached double")


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with a vec_id divisible by ``every``, its ``k`` best among all other rows.

    Vectors that are null, or hold a null or non-finite component, take no part, nor
    do rows with a null vec_id.  Missing components of shorter vectors count zero.
    Ties go to the smaller vec_id.  A row is a candidate of every other row, those with
    its own vec_id included, and each row with a query's vec_id is a query, so ranks
    repeat where a vec_id does.  Components and scores beyond 64 bits stop at the limit.
    """
    rows = staged(integers(vectors).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    size = rows.count()
    queries = staged(first_bounds(rows.where(F.col("vec_id") % every == 0), rows, k), "queries")
    groups = max(-(-size // CANDIDATES), min(GROUPS, -(-size // 256)), 1)
    blocks = -(-queries.count() // QUERIES) or 1
    deal = lambda what, n: F.pmod(F.xxhash64(F.lit(what), "row"), F.lit(n)).cast("int")
    asked = queries.select("row", "vec_id", "v", "reached", deal("queries", blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    given = rows.select("row", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), deal("candidates", groups).alias("g"))
    cells = asked.groupBy("b", "g").cogroup(given.groupBy("b", "g")).applyInPandas(lambda x, y: cell(x, y, k), "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
