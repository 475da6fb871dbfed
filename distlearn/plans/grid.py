"""Density clusters of rows with up to three features on a grid whose cells have the diagonal eps.

Rows of one cell are neighbours of each other, so a cell with enough weight is all core, and the core rows of a cell are one
cluster from the start: clusters are components of cells. Only cells a few steps apart can hold neighbours; they meet by an
equi-join on the cell's number. Rows that ask (not core so far, or on the border) are few in any cell, so they
are held while the rows of a cell, however many, stream past. Two crowded cells are compared by the boxes of ever smaller parts,
and row by row only where boxes leave it open. No pair of rows is ever emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import LARGE, within
from .components import connected_components
from .lineage import discard, settle
from .order import dense_index
from .skew import hot_join
from .tree import beside

MAX_FEATURES = 3
SHRINK = 1 - 1e-6  # cells are a little smaller than they might be, against rounding
EXTENT = 1e9  # cells along one feature at most; and all features together have to fit into a number
PARTS = 4  # a part is cut so many times along each feature
COMPARED = 1_000_000  # pairs of rows that are compared without looking at smaller parts first
BOX = 1e-9  # relative rounding of a distance between boxes


class Grid:
    """Cell numbers: mixed-radix numbers of the steps from the smallest value along each feature."""

    def __init__(self, low: list[float], high: list[float], eps: float):
        self.low, self.d = low, len(low)
        self.side = eps / np.sqrt(self.d) * SHRINK
        self.reach = int(eps / self.side) + 1
        steps = [int((b - a) / self.side) + 2 * self.reach + 2 for a, b in zip(low, high)]
        self.radix = [1]
        for n in steps[:-1]:
            self.radix.append(self.radix[-1] * n)
        self.fits = max(steps) < EXTENT and self.radix[-1] * steps[-1] < 2**62
        moves = product(range(-self.reach, self.reach + 1), repeat=self.d)
        near = [m for m in moves if self.side * np.sqrt(sum(max(abs(v) - 1, 0) ** 2 for v in m)) <= eps]
        self.moves = sorted(sum(v * r for v, r in zip(m, self.radix)) for m in near)

    def number(self) -> Column:
        steps = [F.floor((F.col("x")[i] - F.lit(self.low[i])) / F.lit(self.side)) + self.reach for i in range(self.d)]
        return sum((s * r for s, r in zip(steps[1:], self.radix[1:])), steps[0]).cast("long")

    def part(self, level: int) -> Column:
        """The part that a row lies in, as a hash of its cell and steps at this level; level 0 is the cell itself."""
        if not level:
            return F.col("cell")
        width = self.side / PARTS**level
        return F.xxhash64("cell", F.lit(level), *[F.floor((F.col("x")[i] - F.lit(self.low[i])) / F.lit(width)) for i in range(self.d)])

    def around(self, own: bool) -> Column:
        """The numbers of the cells that may hold a neighbour."""
        return F.explode(F.array(*[F.col("cell") + F.lit(m).cast("long") for m in self.moves if own or m]))


def grid_for(rows: DataFrame, eps: float) -> Grid | None:
    """A grid for rows (x) if they have few features and finite extent; one row of extremes reaches the driver."""
    width = (rows.select(F.size("x")).head() or [0])[0]
    if not 1 <= width <= MAX_FEATURES or eps <= 0:
        return None
    ends = rows.agg(*[f(F.col("x")[i]) for f in (F.min, F.max) for i in range(width)]).head()
    if not np.isfinite(list(ends)).all():
        return None
    grid = Grid(list(ends[:width]), list(ends[width:]), eps)
    return grid if grid.fits else None


def _side(rows: DataFrame, node, f=None, g=None) -> DataFrame:
    return rows.select(
        node.alias("node"), "id", "x", (F.lit(0.0) if f is None else f).cast("double").alias("f"), (F.lit(0) if g is None else g).cast("long").alias("g")
    )


def grid_clusters(groups: DataFrame, grid: Grid, eps: float, need: int) -> DataFrame:
    """Rows (id, x, weight) -> (id, cluster) of core and border rows, clusters numbered by their smallest core id."""
    points = settle(groups.select("id", "x", "weight", grid.number().alias("cell")), "points")
    weights = settle(points.groupBy("cell").agg(F.sum("weight").alias("held"), F.count(F.lit(1)).alias("rows")), "weights")
    dense = weights.where(F.col("held") >= need).select("cell")
    core = settle(_core(points, weights, dense, grid, eps, need), "core")
    if core.isEmpty():
        discard(points, weights, core)
        return groups.select("id", F.lit(0).cast("long").alias("cluster")).limit(0)
    roots = connected_components(_cell_links(core, grid, eps))
    sizes = core.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    rooted = settle(sizes.join(roots.withColumnRenamed("node", "cell"), "cell", "left").withColumn("root", F.coalesce("root", "cell")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    numbered = rooted.join(dense_index(firsts, "first", "cluster").select("root", "cluster"), "root").select("cell", "n", "cluster")
    clustered = settle(hot_join(core, numbered, "cell", "n", F.xxhash64("id")), "clustered")
    border = _border(points.join(core.select("id"), "id", "left_anti"), clustered, grid, eps)
    out = settle(clustered.select("id", "cluster").unionByName(border), "labelled")
    discard(points, weights, core, rooted, clustered)
    return out


def _core(points: DataFrame, weights: DataFrame, dense: DataFrame, grid: Grid, eps: float, need: int) -> DataFrame:
    """(id, x, cell) of rows with ``need`` weight within eps: all of dense cells, and those of others that count enough around them."""
    loose = points.join(dense, "cell", "left_anti")
    own = loose.join(weights, "cell").select("id", F.col("held").alias("n"))
    asked = loose.select("id", "x", grid.around(own=False).alias("node"))

    def count(node: int, asking: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        n = within(asking["x"], rows["x"], eps) @ rows["g"]
        hit = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(asking["id"][hit]), pa.array(n[hit])], ["id", "n"])

    around = beside(_side(points, F.col("cell"), g=F.col("weight")), _side(asked, F.col("node")), count, "id long, n long")
    enough = own.unionByName(around).groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= need).select("id")
    found = loose.join(enough, "id", "left_semi").unionByName(points.join(dense, "cell", "left_semi"))
    return found.select("id", "x", "cell")


def _parts(core: DataFrame, grid: Grid, level: int) -> DataFrame:
    """Parts of cells at a level: what they are part of, their rows and the box around them."""
    ends = [f(F.col("x")[i]).alias(f"{name}{i}") for i in range(grid.d) for f, name in ((F.min, "low"), (F.max, "high"))]
    rows = core.withColumn("part", grid.part(level)).withColumn("of", grid.part(max(level - 1, 0)))
    return rows.groupBy("cell", "of", "part").agg(F.count(F.lit(1)).alias("rows"), *ends)


def _cell_links(core: DataFrame, grid: Grid, eps: float) -> DataFrame:
    """(u, v): cells with core rows within eps of each other, as far as other links don't join them already."""
    cells = settle(_parts(core, grid, 0), "cells")
    named = [c for c in cells.columns if c not in ("cell", "of", "part")]
    a = cells.select(F.col("cell").alias("a"), F.col("part").alias("a_part"), *[F.col(c).alias(f"a_{c}") for c in named], grid.around(own=False).alias("b")).where("a < b")
    b = cells.select(F.col("cell").alias("b"), F.col("part").alias("b_part"), *[F.col(c).alias(f"b_{c}") for c in named])
    open_pairs, links, level, old = a.join(b, "b"), None, 0, [cells]
    while True:
        judged = settle(_judged(open_pairs, grid, eps), "pairs")
        old.append(judged)
        sure = judged.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        links = settle(sure if links is None else links.unionByName(sure).distinct(), "links")
        undecided = judged.where("not linked")
        if undecided.isEmpty():
            break
        roots = connected_components(links)
        for side in "ab":  # pairs of cells that are connected by now need no further look
            named_roots = roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
            undecided = undecided.join(named_roots, side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
        undecided = settle(undecided.where("a_root <> b_root").drop("a_root", "b_root", "linked"), "undecided")
        old.append(undecided)
        few = F.col("a_rows") * F.col("b_rows") <= COMPARED
        links = settle(links.unionByName(_compared(core, undecided.where(few), grid, level, eps)).distinct(), "links")
        crowded = undecided.where(~few).select("a", "a_part", "b", "b_part")
        if crowded.isEmpty():
            break
        level += 1
        busy = crowded.select(F.col("a").alias("cell")).unionByName(crowded.select(F.col("b").alias("cell"))).distinct()
        parts = settle(_parts(core.join(busy, "cell", "left_semi"), grid, level), "parts")
        old.append(parts)
        open_pairs = crowded
        for side in "ab":
            smaller = parts.select(F.col("of").alias(f"{side}_part"), F.col("part").alias(f"{side}_new"), *[F.col(c).alias(f"{side}_{c}") for c in named])
            open_pairs = open_pairs.join(smaller, f"{side}_part").drop(f"{side}_part").withColumnRenamed(f"{side}_new", f"{side}_part")
    discard(*old)
    return links


def _judged(pairs: DataFrame, grid: Grid, eps: float) -> DataFrame:
    """Pairs of parts that may hold neighbours, with ``linked`` where every row of one is a neighbour of every row of the other."""
    gaps, spans = [], []
    for i in range(grid.d):
        a_low, a_high, b_low, b_high = (F.col(f"{s}_{e}{i}") for s in "ab" for e in ("low", "high"))
        gaps.append(F.pow(F.greatest(a_low - b_high, b_low - a_high, F.lit(0.0)), F.lit(2.0)))
        spans.append(F.pow(F.greatest(a_high - b_low, b_high - a_low), F.lit(2.0)))
    nearest, farthest = F.sqrt(sum(gaps[1:], gaps[0])), F.sqrt(sum(spans[1:], spans[0]))
    return pairs.where(nearest <= eps * (1 + BOX)).withColumn("linked", farthest <= eps * (1 - BOX))


def _compared(core: DataFrame, pairs: DataFrame, grid: Grid, level: int, eps: float) -> DataFrame:
    """Links of the pairs of parts that hold neighbours, row by row: the smaller part is held, the other streams."""
    swap = F.col("a_rows") > F.col("b_rows")
    asked = pairs.select(F.when(swap, F.col("b_part")).otherwise(F.col("a_part")).alias("part"), F.when(swap, F.col("a_part")).otherwise(F.col("b_part")).alias("node"))
    placed = core.withColumn("part", grid.part(level))
    asking = placed.join(asked, "part")
    streamed = placed.join(asked.select(F.col("node").alias("part")).distinct(), "part", "left_semi")

    def link(node: int, held: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(within(held["x"], rows["x"], eps))
        pairs = np.unique(np.stack([held["g"][i], rows["g"][j]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["u", "v"])

    met = beside(_side(streamed, F.col("part"), g=F.col("cell")), _side(asking, F.col("node"), g=F.col("cell")), link, "u long, v long")
    return met.where("u < v").distinct()


def _border(rest: DataFrame, clustered: DataFrame, grid: Grid, eps: float) -> DataFrame:
    """(id, cluster) of rows that aren't core but within eps of a core row: the smallest cluster in reach."""
    asked = rest.select("id", "x", grid.around(own=True).alias("node"))

    def smallest(node: int, asking: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        c = np.where(within(asking["x"], rows["x"], eps), rows["g"][None, :], LARGE).min(axis=1)
        hit = c < LARGE
        yield pa.RecordBatch.from_arrays([pa.array(asking["id"][hit]), pa.array(c[hit])], ["id", "cluster"])

    met = beside(_side(clustered, F.col("cell"), g=F.col("cluster")), _side(asked, F.col("node")), smallest, "id long, cluster long")
    return met.groupBy("id").agg(F.min("cluster").alias("cluster"))
