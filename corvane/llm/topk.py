"""Exact top-k inner-product search by tiled matrix products.

Vectors are dealt into a grid of cells: every query block meets every candidate shard in one cell.
A cell multiplies tiles of queries and candidates, keeps a partial top list per query and tile, and
emits k rows a query. Vectors travel as whole numbers of the narrowest type that holds them all. The lists of the shards are then merged up a tree of fixed fan-in, so no task
gathers more than ``fan * k`` rows of a query.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part, nor
does one whose id is null. Vectors of different lengths are not compared. A query id that occurs
repeatedly is asked once (with its smallest vector); a candidate row that occurs repeatedly is
ranked as often as it occurs. Rows with the query's own id are not its candidates. Scores are exact
integers; one that doesn't fit a long is reported as the nearest long. An empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import common

#: Bytes (as they travel) of a block of queries and of a shard of candidates in one cell.
QUERY_BLOCK_BYTES = 32 << 20
SHARD_BYTES = 32 << 20
#: Rows of a tile on either side of a product, and lists merged by a task at each level.
TILE = 1024
FAN = 16


#: Types of whole numbers in a vector, their bytes, and the largest one they hold; doubles hold the rest.
NARROW = (("smallint", 2, 2**15 - 1), ("int", 4, 2**31 - 1), ("double", 8, math.inf))


def tile_top(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, ids and validity of the k best of a tile for each query. ``cid`` is ascending."""
    q, c = q.astype(np.float64), c.astype(np.float64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    own = cid[None, :] == qid[:, None]
    n = len(cid)
    take = min(k, n)
    if most * 2 * TILE < 2**53:
        # one exact number orders by score, then by smaller id
        key = (q @ c.T) * TILE + (TILE - 1 - np.arange(n))
        key[own] = -np.inf
        at = np.argpartition(-key, take - 1, axis=1)[:, :take] if take < n else np.broadcast_to(np.arange(n), (len(q), n))
        best = np.take_along_axis(key, at, 1)
        valid = np.isfinite(best)
        score = np.floor(np.where(valid, best, 0) / TILE).astype(np.int64)
        return score, cid[at], valid
    whole = np.frompyfunc(int, 1, 1)  # exact integers of any size
    s = np.clip(whole(q).dot(whole(c).T), -(2**63), 2**63 - 1).astype(np.int64)
    at = np.lexsort((np.broadcast_to(cid, s.shape), ~s, own), axis=1)[:, :take]
    return np.take_along_axis(s, at, 1), cid[at], ~np.take_along_axis(own, at, 1)


def merged(score: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.lexsort((ids, ~score, ~valid), axis=1)[:, :k]  # ~score reverses the order without overflow
    return tuple(np.take_along_axis(x, at, 1) for x in (score, ids, valid))


def cell_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat (query id, candidate id, score) of the k best of every query among a cell's candidates."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(qid), TILE):
        ids, top = qid[i : i + TILE], None
        for j in range(0, len(cid), TILE):
            new = tile_top(q[i : i + TILE], ids, c[j : j + TILE], cid[j : j + TILE], k)
            top = new if top is None else merged(*(np.concatenate(x, axis=1) for x in zip(top, new, strict=True)), k)
        if top is not None:
            score, found, valid = top
            out.append((np.repeat(ids, found.shape[1])[valid.ravel()], found[valid], score[valid].astype(np.int64)))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query."""
    spark = queries.sparkSession
    common.tune(spark)

    def whole(df: DataFrame) -> DataFrame:
        x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        finite = lambda v: v.isNotNull() & (F.abs(v) < float("inf"))  # noqa: E731  NaN is larger than inf
        x = x.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", finite))
        # rounded down in doubles: FLOOR itself gives a long, which the largest values don't fit
        low = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)
        return x.withColumn("vec", F.transform("vec", lambda v: low(v * scale)))

    asked = whole(queries).groupBy("id").agg(F.min("vec").alias("vec"))
    given = whole(candidates)
    largest = F.max(F.array_max(F.transform("vec", lambda v: F.abs(v))))
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1)), F.coalesce(largest, F.lit(0.0))).first()
    (nq, dim, high), (n, dim2, high2) = size(asked), size(given)
    kind, bytes_ = next((t, b) for t, b, most in NARROW if max(high, high2) <= most)
    asked, given = (df.withColumn("vec", F.col("vec").cast(f"array<{kind}>")) for df in (asked, given))
    width = bytes_ * max(1, dim, dim2)
    blocks = max(1, math.ceil(nq * width / QUERY_BLOCK_BYTES))
    parallel = spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n * width / SHARD_BYTES), math.ceil(min(2 * parallel, n / TILE) / blocks))

    hashed = lambda m: F.pmod(F.xxhash64("id"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = asked.select("*", hashed(blocks).alias("block"), every(shards).alias("shard"), F.lit(True).alias("asked"))
    right = given.select("*", hashed(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asked"))
    cells = left.unionByName(right)

    def search(key: tuple, t: pa.Table) -> pa.Table:
        ids, vec = t.column("id").to_numpy(), t.column("vec").combine_chunks()
        vec = vec if isinstance(vec, pa.Array) else pa.concat_arrays(vec.chunks)
        ask = t.column("asked").to_numpy()
        start = np.concatenate([[0], np.cumsum(np.asarray(vec.value_lengths()))])
        flat, length = vec.flatten().to_numpy(zero_copy_only=False), np.diff(start)
        parts = []
        for d in np.unique(length[ask]):
            rows = [np.flatnonzero((length == d) & (ask == side)) for side in (True, False)]
            if all(len(r) for r in rows):
                a, b = (flat[start[r][:, None] + np.arange(d)[None, :]] for r in rows)
                parts.append(cell_top(ids[rows[0]], a, ids[rows[1]], b, k))
        got = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
        shard = np.full(len(got[0]), t.column("shard")[0].as_py(), np.int64)
        return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2], "shard": shard})

    lists = cells.groupBy("block", "shard").applyInArrow(search, "query_id long, vec_id long, score long, shard long")
    best = [F.col("score").desc(), F.col("vec_id")]
    while shards > FAN:
        shards = math.ceil(shards / FAN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN))
        lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("r") <= k).drop("r")
    top = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    return top.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
