"""Force layouts: attraction along graph edges, repulsion by a distributed quadtree.

Repulsion follows Barnes and Hut (Nature 1986) with the exchange of Warren and Salmon (SC 1993). The plane is cut
into domains of about equal row counts. Each domain builds the quadtree of its own rows, refined where they are
dense, and sends every other domain the cells that are small enough seen from there, opening nearer ones down to
single rows. A domain then builds one tree of its rows and of what it was sent, and sums it for its rows.

A domain has ``8 sqrt(n)`` rows, so there are ``sqrt(n) / 8`` of them and what far domains send each other grows with n
only. The driver sees a hash sample of at most ``8 sqrt(n)`` positions, which decides where rows go and no force.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import discard, settle
from .skew import hot_join

THETA = 0.4  # a cell acts as one point if its extent is below this share of its distance
LEAF_ROWS = 16
BITS = 20  # of a coordinate in the order of a tree's rows: three of them fit into 64 bits
DOMAIN_ROWS = 1024  # at least
SAMPLE_PER_DOMAIN = 64
CUT_EVERY = 5  # epochs after which the domains are cut anew


class Tree:
    """Quadtree (octree, interval tree) over weighted points; cells with up to LEAF_ROWS points are leaves."""

    def __init__(self, y: np.ndarray, w: np.ndarray):
        low = y.min(axis=0)
        side = max(float((y.max(axis=0) - low).max()), 1e-300)
        at = np.minimum((y - low) / side * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
        code = np.zeros(len(y), np.int64)
        for bit in range(BITS - 1, -1, -1):
            for j in range(y.shape[1]):
                code = (code << 1) | ((at[:, j] >> bit) & 1)
        self.order = np.argsort(code, kind="stable")
        code, self.y, self.w = code[self.order], y[self.order], w[self.order]
        first, last = [np.array([0])], [np.array([len(y)])]
        child_first, child_last, made = [], [], 1
        for depth in range(1, BITS + 1):
            split = last[-1] - first[-1] > LEAF_ROWS
            prefix = code >> (y.shape[1] * (BITS - depth))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(prefix)) + 1])
            ends = np.append(starts[1:], len(y))
            parent = np.searchsorted(first[-1], starts, side="right") - 1
            kept = (parent >= 0) & split[parent] & (starts < last[-1][parent])
            children = np.bincount(parent[kept], minlength=len(split))
            ends_at = made + np.cumsum(children)
            child_first.append(ends_at - children)
            child_last.append(ends_at)
            first.append(starts[kept])
            last.append(ends[kept])
            made += int(kept.sum())
            if not kept.any():
                break
        child_first.append(np.full(len(first[-1]), made))
        child_last.append(np.full(len(first[-1]), made))
        self.first, self.last = np.concatenate(first), np.concatenate(last)
        self.child_first, self.child_last = np.concatenate(child_first), np.concatenate(child_last)
        self.leaf = self.child_first == self.child_last
        sums = np.concatenate([np.zeros((1, y.shape[1] + 1)), np.cumsum(np.column_stack([self.w, (self.y - low) * self.w[:, None]]), axis=0)])
        inside = sums[self.last] - sums[self.first]
        self.weight, self.mean = inside[:, 0], low + inside[:, 1:] / inside[:, :1]
        self.low, self.high = np.empty_like(self.mean), np.empty_like(self.mean)
        self._boxes(first)

    def _boxes(self, levels: list[np.ndarray]) -> None:
        """Tight boxes of all cells, a level at a time."""
        at = 0
        for starts in levels:
            here = slice(at, at + len(starts))
            if len(starts):
                # ranges of one level don't overlap; rows between them belong to leaves above
                cuts = np.column_stack([self.first[here], self.last[here]]).ravel()
                closed = cuts if cuts[-1] < len(self.y) else cuts[:-1]
                self.low[here] = np.minimum.reduceat(self.y, closed, axis=0)[::2]
                self.high[here] = np.maximum.reduceat(self.y, closed, axis=0)[::2]
            at += len(starts)

    def walk(self, low: np.ndarray, high: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(box, weight, position) of what acts on each of the boxes: far cells and near points."""
        box, node = np.arange(len(low)), np.zeros(len(low), np.int64)
        found = [(box[:0], self.w[:0], self.y[:0])]
        while len(box):
            away = np.maximum(np.maximum(low[box] - self.mean[node], self.mean[node] - high[box]), 0.0)
            extent = ((self.high[node] - self.low[node]) ** 2).sum(axis=1)
            far = (extent == 0.0) | (extent < theta**2 * (away**2).sum(axis=1))
            found.append((box[far], self.weight[node[far]], self.mean[node[far]]))
            near = ~far & self.leaf[node]
            owner, row = spans(self.first[node[near]], self.last[node[near]])
            found.append((box[near][owner], self.w[row], self.y[row]))
            opened = ~far & ~near
            owner, child = spans(self.child_first[node[opened]], self.child_last[node[opened]])
            box, node = box[opened][owner], child
        return tuple(np.concatenate(parts) for parts in zip(*found))


def spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) of all whole numbers in the ranges from first to last - 1."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]


class Domains:
    """Cuts of the plane at medians of a sample, always across the longer side."""

    def __init__(self, sample: np.ndarray, dims: int):
        self.axis, self.at, self.below, self.above = [], [], [], []  # of cuts; a child below zero is a domain: -1 - number
        self.low, self.high = [], []

        def cut(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> int:
            if len(rows) > SAMPLE_PER_DOMAIN:
                j = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
                if (above_least := rows[rows[:, j] > rows[:, j].min(), j]).size:
                    # rows at one value stay together: where they are half of all, the cut is above them
                    middle = max(float(np.median(rows[:, j])), float(above_least.min()))
                    under = rows[:, j] < middle
                    me = len(self.axis)
                    for kept, value in ((self.axis, j), (self.at, middle), (self.below, 0), (self.above, 0)):
                        kept.append(value)
                    edge = np.arange(dims) == j
                    self.below[me] = cut(rows[under], low, np.where(edge, middle, high))
                    self.above[me] = cut(rows[~under], np.where(edge, middle, low), high)
                    return me
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)

        self.root = cut(sample, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.count = len(self.low)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.axis, self.at = np.array(self.axis, int), np.array(self.at)
        self.below, self.above = np.array(self.below, int), np.array(self.above, int)

    def of(self, y: np.ndarray) -> np.ndarray:
        node = np.full(len(y), self.root)
        while (inner := np.flatnonzero(node >= 0)).size:
            cut = node[inner]
            node[inner] = np.where(y[inner, self.axis[cut]] < self.at[cut], self.below[cut], self.above[cut])
        return -1 - node


def domains_of(positions: DataFrame, dims: int, count: int) -> Domains:
    """Domains of about ``8 sqrt(count)`` rows, from a sample drawn by a hash of the ids."""
    rows = max(DOMAIN_ROWS, int(8 * np.sqrt(count)))
    drawn = positions.where(F.pmod(F.xxhash64("id", F.lit("domain")), F.lit(max(1, rows // SAMPLE_PER_DOMAIN))) == 0)
    table = drawn.select(*[f"y{j}" for j in range(dims)]).toArrow()
    return Domains(_matrix(table, dims), dims)


def _matrix(table, dims: int) -> np.ndarray:
    return np.column_stack([table.column(f"y{j}").to_numpy() for j in range(dims)]).astype(np.float64)


def repulsion(
    positions: DataFrame, dims: int, domains: Domains, force: Callable[[np.ndarray], np.ndarray],
    kernel: Callable[[np.ndarray], np.ndarray] | None = None, theta: float = THETA,
) -> DataFrame:
    """``positions`` (id, y0, ...) with p0, ...: the sum over all other rows of force(d2) * (y - other).

    z is the sum of kernel(d2) over the other rows (0 without a kernel). Rows at one place push each other nowhere.
    """
    ys = [f"y{j}" for j in range(dims)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = domains.of(_matrix(batch, dims)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "domain"])

    def send(table: pa.Table) -> pa.Table:
        own = table.column("domain")[0].as_py()
        others = np.delete(np.arange(domains.count), own)
        y = _matrix(table, dims)
        box, w, at = Tree(y, np.ones(len(y))).walk(domains.low[others], domains.high[others], theta)
        return pa.table([pa.array(others[box].astype(np.int32)), pa.array(w), *[pa.array(at[:, j].copy()) for j in range(dims)]], ["domain", "w", *ys])

    def receive(here: pa.Table, sent: pa.Table) -> pa.Table:
        y, kept = _matrix(here, dims), here.drop_columns(["domain"])
        names = [*kept.column_names, *[f"p{j}" for j in range(dims)], "z"]
        if not len(y):  # rows have left the domain since it was cut
            return pa.table([*kept.columns, *[pa.array([], pa.float64())] * (dims + 1)], names)
        own = Tree(y, np.ones(len(y)))
        weights = sent.column("w").to_numpy() if len(sent) else np.zeros(0)
        met = Tree(np.vstack([y, _matrix(sent, dims)]), np.concatenate([np.ones(len(y)), weights]))
        blocks = np.flatnonzero(own.leaf)
        out = np.zeros((len(y), dims + 1))
        for some in np.array_split(blocks, -(-len(blocks) // 256)):
            box, w, at = met.walk(own.low[some], own.high[some], theta)
            order = np.argsort(box, kind="stable")
            box, w, at = box[order], w[order], at[order]
            edges = np.searchsorted(box, np.arange(len(some) + 1))
            for b, node in enumerate(some):
                theirs = slice(edges[b], edges[b + 1])
                for i in range(own.first[node], own.last[node], 256):  # a leaf has many rows where they are all at one place
                    mine = slice(i, min(i + 256, own.last[node]))
                    gap = own.y[mine, None, :] - at[None, theirs, :]
                    squared = (gap**2).sum(axis=2)
                    out[mine, :dims] = ((w[theirs] * force(squared))[:, :, None] * gap).sum(axis=1)
                    if kernel is not None:
                        out[mine, dims] = kernel(squared) @ w[theirs] - kernel(np.zeros(1))[0]
        back = np.empty_like(out)
        back[own.order] = out
        return pa.table([*kept.columns, *[pa.array(back[:, j].copy()) for j in range(dims + 1)]], names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in positions.schema)
    placed = positions.mapInArrow(assign, fields + ", domain int").repartition(domains.count, "domain")
    pushes = "".join(f", p{j} double" for j in range(dims)) + ", z double"
    if domains.count == 1:  # nothing to exchange
        return placed.groupBy("domain").applyInArrow(lambda table: receive(table, table.slice(0, 0)), fields + pushes)
    doubles = "".join(f", {y} double" for y in ys)
    sent = placed.select("domain", *ys).groupBy("domain").applyInArrow(send, "domain int, w double" + doubles).repartition(domains.count, "domain")
    return placed.groupBy("domain").cogroup(sent.groupBy("domain")).applyInArrow(receive, fields + pushes)


def run_layout(
    edges: DataFrame,
    start: DataFrame,
    dims: int,
    epochs: int,
    attract: Callable[[Column], Column],
    force: Callable[[np.ndarray], np.ndarray],
    kernel: Callable[[np.ndarray], np.ndarray] | None,
    scale: float,
    advance: Callable[[int, list[Column], list[Column], list[Column]], list[tuple[Column, Column]]],
) -> DataFrame:
    """Edges (i, j, w) in both directions and start (id, y0, ...) -> positions (id, y0, ...).

    ``attract(d2)`` is the force factor on ``y_j - y_i``. The repulsion of a node is ``scale`` times its sum of
    ``force(d2)`` times the offset, divided by the sum of ``kernel(d2)`` over all pairs if there is a kernel.
    ``advance(epoch, pull, push, speed)`` gives the new offset and speed per dimension.
    """
    ys, vs = [f"y{j}" for j in range(dims)], [f"v{j}" for j in range(dims)]
    degrees = edges.groupBy(F.col("i").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("strength"))
    now = start.join(degrees, "id", "left").select(
        "id", *ys, *[F.lit(0.0).alias(v) for v in vs], F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("strength", F.lit(0.0)).alias("strength"),
    )
    now = settle(now, "layout")
    total, count = edges.count(), now.count()
    for epoch in range(epochs):
        if epoch % CUT_EVERY == 0:
            domains = domains_of(now, dims, count)
        pushed, factor = repulsion(now, dims, domains, force, kernel), scale
        if kernel is not None:
            pushed = settle(pushed, "pushed")
            factor = scale / max(pushed.agg(F.sum("z")).head()[0] or 0.0, 1e-12)
        moved = _pulled(edges, now, dims, attract, total)
        joined = pushed.join(moved, "id", "left")
        pull = [F.coalesce(f"f{j}", F.lit(0.0)) for j in range(dims)]
        push = [F.col(f"p{j}") * float(factor) for j in range(dims)]
        steps = advance(epoch, pull, push, [F.col(v) for v in vs])
        new = joined.select(
            "id", *[(F.col(y) + s[0]).alias(y) for y, s in zip(ys, steps)], *[s[1].alias(v) for v, s in zip(vs, steps)],
            "n", "strength",
        )
        later = settle(new, "layout")
        discard(now, pushed)
        now = later
    return now.select("id", *ys)


def _pulled(edges: DataFrame, now: DataFrame, dims: int, attract: Callable, total: int) -> DataFrame:
    """Per node the sum over its edges of ``w * attract(d2) * (y_j - y_i)``."""
    here = now.select(F.col("id").alias("i"), "n", *[F.col(f"y{j}").alias(f"a{j}") for j in range(dims)])
    there = now.select(F.col("id").alias("j"), "n", *[F.col(f"y{j}").alias(f"b{j}") for j in range(dims)])
    # the graph is symmetric, so a node's degree is its row count on either side
    met = hot_join(edges, there, "j", "n", F.xxhash64("i"), total=total)
    met = hot_join(met, here, "i", "n", F.xxhash64("j"), total=total)
    gaps = [F.col(f"b{j}") - F.col(f"a{j}") for j in range(dims)]
    squared = gaps[0] * gaps[0]
    for g in gaps[1:]:
        squared = squared + g * g
    factor = F.col("w") * attract(squared)
    return met.groupBy(F.col("i").alias("id")).agg(*[F.sum(factor * g).alias(f"f{j}") for j, g in enumerate(gaps)])
