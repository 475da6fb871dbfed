"""Nearest neighbours by a block matrix join over int8 product tiles.

Vectors are scaled to length one and rounded to 8-bit integers. A tile multiplies a block of queries
with a block of vectors; with the norms of both rounding errors each product gives a lower and an
upper bound of the cosine. Pairs whose upper bound reaches the k-th best lower bound of their query are
recomputed in double precision from the original vectors, and a heap keeps the k best of the tile.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cosines, each_key, matrix, settle, usable_vector

QUERY_BLOCK = 8_192  # queries that meet one block of vectors in one task
VECTOR_BLOCK = 16_384
TILE = 256  # queries of one product
SLACK = 1e-6  # rounding of the bounds themselves
PAIRS = 65_536  # pairs that are recomputed at a time


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(integers, scale, norm of the rounded vector, norm of the rounding error) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    whole = np.rint(x / scale[:, None])
    near = whole * scale[:, None]
    return whole.astype(np.int8), scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_bounds(q: tuple, v: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all cosines between two sets of quantised unit vectors.

    |x.y - x'.y'| <= |y - y'| + |x - x'| |y'|, as |x| = 1. Sums of 8-bit products stay below 2^24
    for up to 1000 components, so the product in single precision is exact; wider ones use double.
    """
    kind = np.float32 if q[0].shape[1] <= 1000 else np.float64
    product = q[0].astype(kind) @ v[0].astype(kind).T
    middle = product.astype(np.float64) * q[1][:, None] * v[1][None, :]
    error = v[3][None, :] + q[3][:, None] * v[2][None, :] + SLACK
    return middle - error, middle + error


def best_of_block(query_ids, queries, ids, vectors, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, id, cosine) of the k nearest in the block for each query, its own id left out."""
    block = quantised(unit(vectors))
    for start in range(0, len(queries), TILE):
        q_ids, q = query_ids[start : start + TILE], queries[start : start + TILE]
        low, high = tile_bounds(quantised(unit(q)), block)
        own = q_ids[:, None] == ids[None, :]
        low[own] = high[own] = -np.inf
        if low.shape[1] > k:
            least = np.partition(low, low.shape[1] - k, axis=1)[:, -k]
        else:
            least = np.full(len(q), -np.inf)
        rows, columns = np.nonzero((high >= least[:, None]) & ~own)
        exact = np.concatenate(
            [np.zeros(0), *(cosines(q[rows[i : i + PAIRS]], vectors[columns[i : i + PAIRS]]) for i in range(0, len(rows), PAIRS))]
        )
        ends = np.searchsorted(rows, np.arange(len(q) + 1))
        out = []
        for i in range(len(q)):
            own_pairs = range(ends[i], ends[i + 1])
            out += [(q_ids[i], ids[columns[j]], exact[j]) for j in heapq.nsmallest(k, own_pairs, key=lambda j: (-exact[j], ids[columns[j]]))]
        if out:
            a, b, c = zip(*out)
            yield np.array(a), np.array(b), np.array(c)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest rows of each query by cosine, ties to smaller ids.

    ``is_query`` is a condition on the rows; a query's own id is no candidate of it. Vectors that are
    null, zero or hold null or non-finite components take no part; vectors of different lengths
    don't meet. Rows with the same id count once, with their best score. An empty table gives an
    empty result; other columns are not read.

    Every block of queries meets every block of vectors in one task: the plan moves each vector once
    per block of queries and each query once per block of vectors.
    """
    rows = settle(
        vectors.where(usable_vector(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("d"), is_query.alias("q")),
        "vectors",
    )
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).head()
    query_blocks, vector_blocks = max(1, -(-counts["q"] // QUERY_BLOCK)), max(1, -(-counts["n"] // VECTOR_BLOCK))
    place = F.xxhash64("id", "v")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    queries = rows.where("q").select("d", F.pmod(place, F.lit(query_blocks)).cast("int").alias("qb"), every(vector_blocks, "vb"), "id", "v", F.lit(0).alias("side"))
    others = rows.select("d", every(query_blocks, "qb"), F.pmod(place, F.lit(vector_blocks)).cast("int").alias("vb"), "id", "v", F.lit(1).alias("side"))
    keys = ["d", "qb", "vb"]
    met = queries.unionByName(others).repartition(*map(F.col, keys)).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in each_key(batches, keys):
            is_q = group.column("side").to_numpy() == 0
            if not is_q.any():
                continue
            ids, v = group.column("id").to_numpy(), matrix(group.column("v"))
            for a, b, c in best_of_block(ids[is_q], v[is_q], ids[~is_q], v[~is_q], k):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["query_id", "id", "score"])

    found = met.mapInArrow(run, "query_id long, id long, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
