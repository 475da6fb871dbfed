"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to length one. A table rounds several random projections to steps of one width and
joins them to a bucket; near vectors share a bucket in some table. All pairs of a bucket are checked by
their exact cosine. Every pair is counted in the first table in which it meets, so nothing is counted twice
and no pair of rows ever leaves a task: a task returns link counts and a spanning set of links.

Equal vectors are one class with a weight. The number of projections grows with the logarithm of the
number of classes, so that chance meetings stay at about ``CHANCE`` per bucket, and the number of
tables follows from the miss rate allowed for a pair at the threshold itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import connected_components, contract
from ..plans.lineage import discard
from .common import cosines, each_key, matrix, paired_pieces, settle, usable_vector
from .neighbours import unit

NEAR = 0.9
WIDTH = 3.0  # of a step, in lengths of the unit vectors
CHANCE = 200
MISS = 0.002
BUCKET = 4_096  # vectors of one bucket that one task compares with each other
TILE = 512


def same_step(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at a distance fall into one step of a random projection."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))  # normal distribution at -r
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_sizes(count: int, near: float = NEAR, miss: float = MISS) -> tuple[int, int]:
    """(projections per table, tables) for so many vectors."""
    far, close = same_step(math.sqrt(2)), same_step(math.sqrt(max(1e-6, 2 - 2 * near)))
    projections = max(1, math.ceil(math.log(max(1, count) / CHANCE + 1) / -math.log(far)))
    hit = close**projections
    return projections, max(1, math.ceil(math.log(miss) / math.log(1 - hit))) if hit < 1 else 1


def bucket_ids(x: np.ndarray, projections: int, tables: int, seed: int = 7) -> np.ndarray:
    """Bucket of each unit row in each table, as 32-bit hashes of the rounded projections."""
    draw = np.random.default_rng([seed, x.shape[1]])
    directions = draw.standard_normal((x.shape[1], projections * tables))
    shift = draw.uniform(0, WIDTH, projections * tables)
    factors = draw.integers(1, 2**62, (tables, projections), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    steps = np.floor((x @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, projections)
    return ((steps * factors).sum(axis=2, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def compare(v: np.ndarray, buckets: np.ndarray, table: int, own: np.ndarray, piece: int, other: int, near: float):
    """(row, row) of all pairs of one bucket that are near and don't meet in an earlier table."""
    left = np.flatnonzero(own == piece)
    right = left if piece == other else np.flatnonzero(own == other)
    x = unit(v)
    for a in range(0, len(left), TILE):
        i = left[a : a + TILE]
        for b in range(a if piece == other else 0, len(right), TILE):
            j = right[b : b + TILE]
            rough = x[i] @ x[j].T
            p, q = np.nonzero(rough >= near - 1e-9)
            p, q, value = i[p], j[q], rough[p, q]
            if piece == other:
                keep = p < q
                p, q, value = p[keep], q[keep], value[keep]
            unsure = np.abs(value - near) < 1e-9
            value[unsure] = cosines(v[p[unsure]], v[q[unsure]])
            keep = value >= near
            p, q = p[keep], q[keep]
            for start in range(0, len(p), 65_536):
                pp, qq = p[start : start + 65_536], q[start : start + 65_536]
                new = ~(buckets[pp, :table] == buckets[qq, :table]).any(axis=1)
                yield pp[new], qq[new]


def near_duplicates(vectors: DataFrame, near: float = NEAR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors
    of different lengths don't meet. Each row gives one row, equal ids included (they are different
    rows). An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    good = usable_vector("v")
    classes = settle(rows.where(good).groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    projections, tables = table_sizes(classes.count(), near)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("d").to_numpy()
            for d in np.unique(widths):
                part = batch.filter(pa.array(widths == d))
                ids = bucket_ids(unit(matrix(part.column("v"))), projections, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * tables, pa.int32()), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "buckets"])

    typed = classes.withColumn("d", F.size("v"))
    indexed = settle(typed.mapInArrow(hashed, T.StructType([*typed.schema.fields, T.StructField("buckets", T.ArrayType(T.IntegerType()))])), "indexed")
    placed = indexed.select("d", F.posexplode("buckets").alias("t", "bucket"), "rep", "n", "v", "buckets")
    keys = ["d", "t", "bucket"]
    dealt = paired_pieces(placed, keys, F.xxhash64("rep"), BUCKET)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in each_key(batches, [*keys, "piece", "other"]):
            if group.num_rows < 2:
                continue
            reps, n, own = (group.column(c).to_numpy() for c in ("rep", "n", "own"))
            t, piece, other = (group.column(c)[0].as_py() for c in ("t", "piece", "other"))
            buckets = group.column("buckets").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
            counts = np.zeros(group.num_rows, np.int64)
            for p, q in compare(matrix(group.column("v")), buckets, t, own, piece, other, near):
                np.add.at(counts, p, n[q])
                np.add.at(counts, q, n[p])
                if len(p):
                    pairs = pa.RecordBatch.from_arrays([pa.array(np.maximum(reps[p], reps[q])), pa.array(np.minimum(reps[p], reps[q]))], ["u", "v"])
                    for star in contract(iter([pairs])):
                        yield pa.RecordBatch.from_arrays([*star.columns, pa.nulls(star.num_rows, pa.int64())], ["a", "b", "links"])
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.nulls(len(at), pa.int64()), pa.array(counts[at])], ["a", "b", "links"])

    found = settle(dealt.mapInArrow(linked, "a long, b long, links long"), "links")
    discard(indexed)
    counted = found.where("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links is null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = (
        classes.join(counted, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    linked_rows = rows.where(good).join(known, "v").select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked_rows.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)
