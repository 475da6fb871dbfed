"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import discard, settle
from .skew import hot_join

MAX_ROUNDS = 100
CONTRACT_ROWS = 1_000_000  # edges that one task contracts together


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace edges by stars with the same components, at most CONTRACT_ROWS edges at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CONTRACT_ROWS:
            yield _stars(held)
            held, size = [], 0
    if size:
        yield _stars(held)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    u, v = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["u", "v"])


def _is_settled(edges: DataFrame) -> bool:
    """True when every node either points once to a root or is a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 or (out > 0 and into > 0)").limit(1).count() == 0


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest node next to u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    met = hot_join(both, least, "u", "n", F.xxhash64("v"), total=2 * count)
    return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    met = hot_join(edges, least, "u", "n", F.xxhash64("v"), total=count)
    lower = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) -> (node, root) for every node with an edge; root = smallest node.

    Hubs are salted inside the joins; each round is written out, so the plan stays short.
    """
    ordered = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    first = settle(ordered.distinct(), "edges")
    count = first.count()
    parts = max(1, -(-count // CONTRACT_ROWS))
    stars = first.coalesce(parts).mapInArrow(contract, "u long, v long")
    now = settle(stars if parts == 1 else stars.distinct(), "stars")
    discard(first)
    rounds = 0
    while parts > 1 and not _is_settled(now):
        rounds += 1
        if rounds > MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        wide = settle(_large_star(now, now.count()), "large")
        new = settle(_small_star(wide, wide.count()), "small")
        discard(now, wide)
        now = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
