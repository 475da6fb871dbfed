"""Density clusters (DBSCAN) without a list of neighbouring pairs.

If many rows are equal, they are merged into one weighted point. Cells answer most questions at once: a cell
that lies wholly within eps of a point adds its weight without looking inside, and a cell
of diameter <= eps with enough weight is one lump of core points. Only the remaining cells
are compared block by block, and each comparison returns at most one row per point: a
count, a spanning set of links, or the smallest neighbouring cluster. Rows with up to three features go through
the grid of ``grid.py`` instead. Where eps reaches into most cells (a sample of points tells), sending a point to each
would take more disk than the points by far; then all blocks of points meet as in ``blocks.py``, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import to_matrix
from .blocks import Kernel, across, packed, tiles
from .cells import (
    COPIES,
    LARGE,
    ROUTE_ROWS,
    Cells,
    assign,
    block_of,
    cell_counts,
    draw_rows,
    heaviest_copy,
    measure,
    meet,
    pivot_count,
    routed_batches,
    within,
)
from .components import connected_components
from .grid import grid_clusters, grid_for
from .lineage import discard, settle
from .order import dense_index
from .skew import hot_join

NOISE = -1
VISITS = 8  # cells that a point may have to be sent to, on average
ASKED = 2000  # points that tell how many it would be


def density_clusters(rows: DataFrame, eps: float, min_samples: int, cell_rows: int) -> DataFrame:
    """Rows (id, x) -> (id, cluster); clusters are numbered by their smallest core id, noise is -1."""
    merge = heaviest_copy(rows) > COPIES
    if merge:
        groups = rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    else:
        groups = rows.withColumn("weight", F.lit(1).cast("long"))
    groups = settle(groups, "groups")
    distinct, total = groups.agg(F.count(F.lit(1)), F.sum("weight")).head()
    if distinct == 0:
        return rows.select("id", F.lit(NOISE).cast("long").alias("cluster"))
    grid = grid_for(groups, eps)
    labelled = grid_clusters(groups, grid, eps, min_samples) if grid else _cell_clusters(groups, distinct, eps, min_samples, cell_rows)
    cluster = F.coalesce("cluster", F.lit(NOISE).cast("long")).alias("cluster")
    if not merge:
        return rows.select("id").join(labelled, "id", "left").select("id", cluster)
    answers = groups.join(labelled, "id", "left").select("x", "weight", cluster)
    joined = hot_join(rows.select("id", "x"), answers, "x", "weight", F.xxhash64("id"), total=total)
    return joined.select("id", "cluster")


def _cell_clusters(groups: DataFrame, distinct: int, eps: float, min_samples: int, cell_rows: int) -> DataFrame:
    """(id, cluster) of core and border rows by cells around pivots, for rows with many features."""
    cells = Cells(draw_rows(groups, pivot_count(distinct, cell_rows), distinct))
    points = settle(assign(groups, cells), "points")
    measure(points, cells, "weight")

    if _visits(points, cells, distinct, eps) > VISITS:
        labelled = _block_clusters(points.select("id", "x", "weight"), distinct, eps, min_samples)
        discard(points)
        return labelled
    lumps = (2.0 * cells.radius <= eps) & (cells.weight >= min_samples)
    core = _core_points(points, cells, lumps, eps, min_samples)
    filled = Cells(cells.pivots)
    floor = measure(core, filled)
    if floor is None:
        return groups.select("id", F.lit(NOISE).cast("long").alias("cluster")).limit(0)
    clustered = _core_clusters(core, filled, floor, lumps, eps)
    labelled = _with_border(points, clustered, filled, eps)
    discard(core, clustered, points)
    return labelled


def _visits(points: DataFrame, cells: Cells, count: int, eps: float) -> float:
    """Cells that reach into eps of a point but don't lie within it, on average over about ASKED points."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _parts(batches, cells):
            low, high = cells.bounds(x)
            yield pa.RecordBatch.from_arrays([pa.array(((low <= eps) & (high > eps)).sum(axis=1))], ["n"])

    drawn = points.select("id", "x").where(F.pmod(F.xxhash64("id"), F.lit(max(1, count // ASKED))) == 0)
    return drawn.mapInArrow(opened, "n long").agg(F.avg("n")).head()[0] or 0.0


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    return np.concatenate([within(a[t], b, eps) for t in tiles(len(a))])


def _block_clusters(points: DataFrame, count: int, eps: float, need: int) -> DataFrame:
    """Points (id, x, weight) -> (id, cluster) of core and border points, by products of blocks."""
    d = points.select(F.size("x")).head()[0]

    class Count(Kernel):
        def begin(self, q):
            self.q, self.sums = q, np.zeros(len(q["id"]), np.int64)

        def meet(self, p):
            near, ones = _near(self.q["x"], p["x"], eps), (p["weight"] == 1).all()
            self.sums += np.count_nonzero(near, axis=1) if ones else (near @ p["weight"].astype(np.float64)).astype(np.int64)

        def end(self):
            yield pa.RecordBatch.from_arrays([pa.array(self.q["id"]), pa.array(self.sums)], ["id", "n"])

    whole = settle(packed(points, d, "weight"), "blocks")
    counted = across(whole.select("no", "id", "x"), whole, count, count, d, Count, "id long, n long")
    dense = settle(counted.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= need).select("id"), "dense")
    core = settle(points.join(dense, "id", "left_semi").select("id", "x"), "core")
    cores = core.count()
    if not cores:
        discard(whole, dense, core)
        return points.select("id", F.lit(NOISE).cast("long").alias("cluster")).limit(0)
    mine = settle(packed(core, d), "blocks")
    found = across(mine, mine, cores, cores, d, lambda: _Spanning(eps), "u long, v long")
    roots = connected_components(found)
    rooted = core.select("id").join(roots, core["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("root"))
    rooted = settle(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    numbered = dense_index(firsts, "first", "cluster").select("root", "n", "cluster")
    clustered = settle(hot_join(rooted, numbered, "root", "n", F.xxhash64("id"), total=cores).select("id", "cluster"), "clustered")
    rest = settle(points.join(dense, "id", "left_anti").select("id", "x"), "rest")
    named = settle(packed(core.join(clustered, "id"), d, "cluster"), "blocks")

    class Least(Kernel):
        def begin(self, q):
            self.q, self.least = q, np.full(len(q["id"]), LARGE)

        def meet(self, p):
            for t in tiles(len(self.least)):
                near = within(self.q["x"][t], p["x"], eps)
                self.least[t] = np.minimum(self.least[t], np.where(near, p["cluster"][None, :], LARGE).min(axis=1))

        def end(self):
            got = self.least < LARGE
            yield pa.RecordBatch.from_arrays([pa.array(self.q["id"][got]), pa.array(self.least[got])], ["id", "cluster"])

    reached = across(packed(rest, d), named, rest.count(), cores, d, Least, "id long, cluster long")
    border = reached.groupBy("id").agg(F.min("cluster").alias("cluster"))
    labelled = settle(clustered.unionByName(border), "labelled")
    discard(whole, dense, core, mine, rooted, clustered, rest, named)
    return labelled


class _Spanning(Kernel):
    """Links of all points that a task met to the smallest number of their component; pairs of blocks are looked at once."""

    def __init__(self, eps: float):
        self.eps, self.at, self.ids = eps, {}, []
        self.parent = np.zeros(0, np.int64)

    def _numbers(self, block: dict) -> np.ndarray:
        if block["no"] not in self.at:
            first = len(self.parent)
            self.at[block["no"]] = np.arange(first, first + len(block["id"]))
            self.parent = np.concatenate([self.parent, self.at[block["no"]]])
            self.ids.append(block["id"].copy())
        return self.at[block["no"]]

    def _roots(self, nodes: np.ndarray) -> np.ndarray:
        root = self.parent[nodes]
        while (self.parent[root] != root).any():
            root = self.parent[root]
        self.parent[nodes] = root
        return root

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self._roots(a), self._roots(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def meet(self, p: dict) -> None:
        if p["no"] < self.q["no"]:
            return  # another task or block has the pair the other way round
        mine, theirs = self._numbers(self.q), self._numbers(p)
        for t in tiles(len(mine)):
            near = within(self.q["x"][t], p["x"], self.eps)
            while True:
                crossing = near & (self._roots(mine[t])[:, None] != self._roots(theirs)[None, :])
                rows, cols = crossing.any(axis=1), crossing.any(axis=0)
                if not rows.any():
                    break
                self._join(mine[t][rows], theirs[crossing[rows].argmax(axis=1)])
                self._join(mine[t][crossing[:, cols].argmax(axis=0)], theirs[cols])

    def last(self) -> Iterator[pa.RecordBatch]:
        if self.ids:
            ids, root = np.concatenate(self.ids), self._roots(np.arange(len(self.parent)))
            far = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["u", "v"])


def _flag(values: np.ndarray) -> Column:
    return F.element_at(F.expr(f"array({','.join('true' if v else 'false' for v in values)})"), F.col("cell") + 1)


def _core_points(points: DataFrame, cells: Cells, lumps: np.ndarray, eps: float, need: int) -> DataFrame:
    """The points with at least ``need`` weight within eps, themselves included."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in _parts(batches, cells):
            low, high = cells.bounds(x)
            inside = high <= eps
            sure = inside @ cells.weight
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), -1, np.int32)), pa.array(np.zeros(len(x))), pa.array(sure.astype(np.int64)),
                 pa.array(ids), pa.array([[]] * len(x), pa.list_(pa.float64()))],
                ["cell", "dist", "sure", "id", "x"],
            )
            open_cells = (low <= eps) & ~inside & (sure < need)[:, None]
            yield from routed_batches(x, open_cells, {"dist": cells.distances(x), "sure": sure.astype(np.int64), "id": ids})

    asked = points.where(~_flag(lumps)).select("id", "x")
    routed = settle(asked.mapInArrow(route, "cell int, dist double, sure long, id long, x array<double>"), "routed")
    open_rows = routed.where("cell >= 0").drop("sure")

    def count(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in records:
            near = within(block_of(r, "q"), block_of(r, "b"), eps)
            yield pa.RecordBatch.from_arrays([pa.array(r["q_ids"]), pa.array(near @ r["b_weight"])], ["id", "sure"])

    counted = meet(
        open_rows, points.select("cell", "dist", "id", "x", "weight"),
        cell_counts(open_rows, len(cells)), cells.rows, count, "id long, sure long",
    )
    totals = routed.where("cell < 0").select("id", "sure").unionByName(counted)
    dense = totals.groupBy("id").agg(F.sum("sure").alias("sure")).where(F.col("sure") >= need).select("id")
    loose = points.where(~_flag(lumps)).join(dense, "id", "left_semi")
    core = settle(loose.unionByName(points.where(_flag(lumps))), "core")
    discard(routed)
    return core


def _core_clusters(core: DataFrame, filled: Cells, floor: int, lumps: np.ndarray, eps: float) -> DataFrame:
    """Core points -> the same with ``cluster`` 0..K-1. ``floor`` is the smallest core id."""
    # cells are nodes too, numbered below all ids
    cell_node = floor - 1 - np.arange(len(filled), dtype=np.int64)
    node = F.when(_flag(lumps), F.lit(int(floor) - 1) - F.col("cell")).otherwise(F.col("id"))
    core = core.withColumn("node", node)

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, nodes in _parts(batches, filled, "node"):
            _, high = filled.bounds(x)
            inside = (high <= eps) & (filled.rows > 0)
            yield from _links(nodes, cell_node, inside)

    sure = settle(core.select("node", "x").mapInArrow(certain, "u long, v long").distinct(), "sure")
    # a cell with a link lies wholly within eps of some core point: its core points are one cluster
    touched = sure.where((F.col("u") < floor) | (F.col("v") < floor))
    ends = touched.select(F.explode(F.array("u", "v")).alias("n")).where(F.col("n") < floor).distinct()
    whole = lumps.copy()
    for (n,) in ends.collect():  # at most one row per cell
        whole[floor - 1 - n] = True
    members = core.where(_flag(whole & ~lumps)).select(F.col("node").alias("u"), (F.lit(int(floor) - 1) - F.col("cell")).alias("v"))
    group = np.where(whole, np.arange(len(filled)), -1)
    if whole.sum() > 1:
        between = connected_components(touched.where((F.col("u") < floor) & (F.col("v") < floor)))
        for n, root in between.collect():  # at most one row per cell
            group[floor - 1 - n] = floor - 1 - root

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, nodes in _parts(batches, filled, "node"):
            low, high = filled.bounds(x)
            inside = high <= eps
            linked = inside & whole
            own = floor - 1 - nodes
            lumped = np.flatnonzero(own >= 0)
            linked[lumped, own[lumped]] = True
            done = np.zeros_like(inside)
            for g in np.unique(group[linked.any(axis=0)]):
                if g >= 0:
                    same = np.flatnonzero(group == g)
                    done[:, same] = linked[:, same].any(axis=1)[:, None]
            open_cells = (low <= eps) & ~inside & ~done
            yield from routed_batches(x, open_cells, {"dist": filled.distances(x), "id": nodes, "node": nodes})

    routed = settle(
        core.select("node", "x").mapInArrow(route, "cell int, dist double, id long, node long, x array<double>"), "open"
    )

    def link(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in records:
            yield from _links(r["q_node"], r["b_node"], within(block_of(r, "q"), block_of(r, "b"), eps))

    found = meet(
        routed, core.select("cell", "dist", "id", "x", "node"), cell_counts(routed, len(filled)), filled.rows, link,
        "u long, v long",
    )
    roots = connected_components(sure.unionByName(members).unionByName(found))
    joined = core.join(roots, core["node"] == roots["node"], "left").select(
        core["cell"], core["dist"], core["id"], core["x"], F.coalesce(roots["root"], core["node"]).alias("root")
    )
    joined = settle(joined, "rooted")
    discard(sure, routed)
    firsts = joined.groupBy("root").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    numbered = dense_index(firsts, "first", "cluster").select("root", "n", "cluster")
    clustered = hot_join(joined, numbered, "root", "n", F.xxhash64("id"), total=int(filled.rows.sum())).drop("root")
    clustered = settle(clustered.select("cell", "dist", "id", "x", "cluster"), "clustered")
    discard(joined)
    return clustered


def _with_border(points: DataFrame, core: DataFrame, filled: Cells, eps: float) -> DataFrame:
    """(id, cluster) of core points and of the points within eps of one (smallest cluster)."""
    best = np.full(len(filled), LARGE)
    for cell, c in core.groupBy("cell").agg(F.min("cluster")).collect():  # at most one row per cell
        best[cell] = c

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, ids in _parts(batches, filled):
            low, high = filled.bounds(x)
            inside = (high <= eps) & (filled.rows > 0)
            sure = np.where(inside, best, LARGE).min(axis=1)
            # only cells that may hold a smaller cluster are worth a look
            open_cells = (low <= eps) & ~inside & (best < sure[:, None])
            got = np.flatnonzero(sure < LARGE)
            if len(got):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(got), -1, np.int32)), pa.array(np.zeros(len(got))), pa.array(sure[got]),
                     pa.array(ids[got]), pa.array([[]] * len(got), pa.list_(pa.float64()))],
                    ["cell", "dist", "cluster", "id", "x"],
                )
            yield from routed_batches(x, open_cells, {"dist": filled.distances(x), "cluster": sure, "id": ids})

    rest = points.join(core.select("id"), "id", "left_anti").select("id", "x")
    routed = settle(rest.mapInArrow(route, "cell int, dist double, cluster long, id long, x array<double>"), "border")
    open_rows = routed.where("cell >= 0").drop("cluster")

    def smallest(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for r in records:
            near = within(block_of(r, "q"), block_of(r, "b"), eps)
            c = np.where(near, r["b_cluster"][None, :], LARGE).min(axis=1)
            got = c < LARGE
            yield pa.RecordBatch.from_arrays([pa.array(r["q_ids"][got]), pa.array(c[got])], ["id", "cluster"])

    looked = meet(open_rows, core, cell_counts(open_rows, len(filled)), filled.rows, smallest, "id long, cluster long")
    reached = routed.where("cell < 0").select("id", "cluster").unionByName(looked)
    border = reached.groupBy("id").agg(F.min("cluster").alias("cluster"))
    labelled = settle(core.select("id", "cluster").unionByName(border), "labelled")
    discard(routed)
    return labelled


def _parts(batches: Iterator[pa.RecordBatch], cells: Cells, key: str = "id"):
    for batch in batches:
        x, ids = to_matrix(batch.column("x"), cells.pivots.shape[1]), batch.column(key).to_numpy()
        for i in range(0, len(x), ROUTE_ROWS):
            yield x[i : i + ROUTE_ROWS], ids[i : i + ROUTE_ROWS]


def _links(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A spanning set of links (at most one per row and column) for a bipartite neighbour mask."""
    rows, cols = near.any(axis=1), near.any(axis=0)
    if not rows.any():
        return
    left, right, near = left[rows], right[cols], near[np.ix_(rows, cols)]
    a, b = left.copy(), right.copy()
    while True:
        new_a = np.minimum(a, np.where(near, b[None, :], LARGE).min(axis=1))
        new_b = np.minimum(b, np.where(near, new_a[:, None], LARGE).min(axis=0))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    pairs = np.unique(np.column_stack([np.concatenate([left, right]), np.concatenate([a, b])]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]] if len(pairs) else pairs
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])
