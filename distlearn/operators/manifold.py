"""Low-dimensional maps of a neighbour graph: t-SNE and UMAP.

The neighbour graph comes from the exact distributed search; the layout runs as in
``plans/layout.py``. Repulsion is taken from grid cells, for UMAP as the expected value of
its negative draws, so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Fitted, Learner
from ..functions.vectors import to_lists, to_matrix
from ..plans.cells import CELL_ROWS
from ..plans.layout import run_layout
from ..plans.lineage import settle
from ..plans.skew import hot_join
from .decomposition import PCA
from .neighbors import NearestNeighbors, NeighborsModel, keyed_points

MAX_DIMS = 3  # the repulsion grid covers up to three dimensions


def tsne_weights(d: np.ndarray, perplexity: float, steps: int = 50) -> np.ndarray:
    """Rows of neighbour distances -> rows of probabilities with the wanted perplexity."""
    squared = d**2 - (d**2).min(axis=1, keepdims=True)
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    mean = squared.mean(axis=1)
    beta = np.where(mean > 0, 1.0 / np.where(mean > 0, mean, 1.0), 1.0)
    for _ in range(steps):
        p = np.exp(-squared * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * (squared * p).sum(axis=1) / total
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2.0, (low + np.minimum(high, 1e300)) / 2.0)
    p = np.exp(-squared * beta[:, None])
    return p / p.sum(axis=1, keepdims=True)


def umap_weights(d: np.ndarray, steps: int = 50) -> np.ndarray:
    """Rows of neighbour distances -> membership strengths that sum to log2(k)."""
    target = np.log2(max(d.shape[1], 2))
    nonzero = np.where(d > 0, d, np.inf).min(axis=1)
    rho = np.where(np.isinf(nonzero), 0.0, nonzero)
    gap = np.maximum(d - rho[:, None], 0.0)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(steps):
        total = np.exp(-gap / sigma[:, None]).sum(axis=1)
        big = total > target
        low, high = np.where(big, low, sigma), np.where(big, sigma, high)
        sigma = np.where(np.isinf(high), sigma * 2.0, (low + np.minimum(high, 1e300)) / 2.0)
    floor = 1e-3 * np.maximum(d.mean(axis=1), 1e-12)
    return np.exp(-gap / np.maximum(sigma, floor)[:, None])


def neighbour_weights(found: DataFrame, k: int, weigh, drop_self: bool) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) -> (i, j, w); one bounded array per query."""
    rows = found.where("query_id <> neighbor_id") if drop_self else found
    entry = F.struct("rank", "neighbor_id", "distance")
    lists = rows.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("f"))
    lists = lists.select(
        F.col("query_id").alias("i"), F.col("f.neighbor_id").alias("near"), F.col("f.distance").alias("d")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = weigh(to_matrix(batch.column("d")))
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("near"), to_lists(w)], ["i", "near", "w"])

    weighed = lists.mapInArrow(run, "i long, near array<long>, w array<double>")
    pairs = F.explode(F.arrays_zip(F.col("near").alias("j"), F.col("w").alias("w"))).alias("e")
    return weighed.select("i", pairs).select("i", F.col("e.j").alias("j"), F.col("e.w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


class _MapModel(Fitted):
    HYPER = {"output_col": "embedding"}

    def _placed(self, df: DataFrame) -> DataFrame:
        """Positions of the fitted rows, found by id."""
        key = self.setting("id_col")
        table = self.tables["positions"]
        ys = sorted(c for c in table.columns if c.startswith("y"))
        placed = table.select(F.col("id").alias(key), F.array(*ys).alias(self.setting("output_col")))
        return df.drop(self.setting("output_col")).join(placed, key)


class _MapLearner(Learner):
    HYPER = {**_MapModel.HYPER, "n_components": 2, "random_state": 0, "cell_rows": CELL_ROWS}

    def _search(self, df: DataFrame, k: int) -> tuple[NeighborsModel, DataFrame, int]:
        finder = NearestNeighbors(
            n_neighbors=k + 1, features_col=self.setting("features_col"), id_col=self.setting("id_col"),
            handle_invalid=self.setting("handle_invalid"), cell_rows=self.setting("cell_rows"),
        )
        model = finder.fit(df)
        n = model.state["total"]
        return model, model.kneighbors(df, min(k + 1, n)), n

    def _start(self, df: DataFrame, spread: float) -> DataFrame:
        """Principal component scores scaled to a common spread, with a hash-drawn nudge for equal rows."""
        c = self.setting("n_components")
        if not 1 <= c <= MAX_DIMS:
            raise ValueError(f"n_components must be 1 to {MAX_DIMS}")
        points = settle(keyed_points(df, self), "points")
        model = PCA(features_col="x", output_col="z", n_components=c).fit(points)
        size = np.sqrt(max(model.state["explained_variance"][0], 1e-300))
        draw = [F.pmod(F.xxhash64("id", F.lit(int(self.setting("random_state"))), F.lit(j)), F.lit(1 << 20)) for j in range(c)]
        return model.transform(points).select(
            "id", *[(F.col("z")[j] * float(spread / size) + (draw[j] / float(1 << 20) - 0.5) * float(spread * 0.01)).alias(f"y{j}")
                    for j in range(c)],
        )


class TSNEModel(_MapModel):
    """tables: positions. New rows cannot be placed."""

    VERBS = frozenset({"fit_transform"})

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._placed(df)


class TSNE(_MapLearner):
    """t-SNE; only ``fit_transform``, since the map holds for the fitted rows alone."""

    HYPER = {
        "perplexity": 30.0,
        "n_neighbors": None,
        "early_exaggeration": 12.0,
        "learning_rate": "auto",
        "max_iter": 100,
    }
    VERBS = frozenset({"fit_transform"})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self._need("fit_transform")
        df = self._rows(df, False)
        perplexity = float(self.setting("perplexity"))
        k = self.setting("n_neighbors") or int(3 * perplexity)
        _, found, n = self._search(df, k)
        if n < 2:
            raise ValueError("t-SNE needs at least two rows")
        perplexity = min(perplexity, (n - 1) / 3.0 + 1.0)
        one_way = neighbour_weights(found, k, lambda d: tsne_weights(d, perplexity), True)
        edges = both_ways(one_way).groupBy("i", "j").agg((F.sum("w") / (2.0 * n)).alias("w"))
        edges = settle(edges, "graph")
        epochs, boost = self.setting("max_iter"), self.setting("early_exaggeration")
        rate = self.setting("learning_rate")
        rate = max(n / boost / 2.0, 1.0) if rate == "auto" else rate
        early = epochs // 2

        def advance(epoch, pull, push, speed):
            factor, momentum = (boost, 0.5) if epoch < early else (1.0, 0.8)
            out = []
            for f, p, v in zip(pull, push, speed):
                new = v * momentum + (f * float(factor) + p) * float(4.0 * rate)
                out.append((new, new))
            return out

        positions = run_layout(
            edges, self._start(df, 1.0), self.setting("n_components"), epochs,
            lambda d2: F.lit(1.0) / (d2 + 1.0), lambda s: 1.0 / (1.0 + s) ** 2, lambda s: 1.0 / (1.0 + s), 1.0, advance,
        )
        self.model_ = self._give(TSNEModel({}, {"positions": positions}))
        return self.model_.transform(df)


def curve(min_dist: float, spread: float) -> tuple[float, float]:
    """a, b such that 1/(1 + a d^(2b)) follows 1 up to min_dist, then exp(-(d - min_dist)/spread)."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([0.0, 0.0]), 1e-2  # logarithms of a and b

    def value(p):
        return 1.0 / (1.0 + np.exp(p[0]) * x ** (2.0 * np.exp(p[1])))

    cost = ((value(p) - y) ** 2).sum()
    for _ in range(200):
        j = np.column_stack([(value(p + e) - value(p - e)) / 2e-6 for e in np.eye(2) * 1e-6])
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), j.T @ (y - value(p)))
        new = ((value(p + step) - y) ** 2).sum()
        if new < cost:
            p, cost, damp = p + step, new, damp / 3.0
        else:
            damp *= 4.0
    return float(np.exp(p[0])), float(np.exp(p[1]))


class UMAPModel(_MapModel):
    """tables: positions, points; new rows go to the weighted mean of their neighbours."""

    HYPER = {"n_neighbors": 15, "min_dist": 0.1, "spread": 1.0}
    VERBS = frozenset({"fit", "transform", "fit_transform"})

    def _transform(self, df: DataFrame) -> DataFrame:
        df = self._input(df)
        finder = NeighborsModel({k: self.state[k] for k in ("copies", "total")}, self.tables)
        finder = self._give(finder)
        k = min(self.setting("n_neighbors"), int(self.state["total"]))
        edges = settle(neighbour_weights(finder.kneighbors(df, k), k, umap_weights, False), "reach")
        table = self.tables["positions"]
        ys = sorted(c for c in table.columns if c.startswith("y"))
        used = edges.groupBy("j").agg(F.count(F.lit(1)).alias("n"))
        places = used.join(table.withColumnRenamed("id", "j"), "j")
        met = hot_join(edges, places, "j", "n", F.xxhash64("i"), total=edges.count())
        # at most k places per query, summed in a fixed order
        places = F.sort_array(F.collect_list(F.struct("j", "w", *ys))).alias("near")
        key = self.setting("id_col")
        lists = met.groupBy(F.col("i").alias(key)).agg(places)

        def total(value):
            return F.aggregate("near", F.lit(0.0), lambda s, p: s + value(p))

        weight = total(lambda p: p["w"])
        means = [total(lambda p, y=y: p["w"] * p[y]) / weight for y in ys]
        placed = lists.select(key, F.array(*means).alias(self.setting("output_col")))
        return df.drop(self.setting("output_col")).join(placed, key)


class UMAP(_MapLearner):
    """UMAP by batch gradient steps on the fuzzy neighbour graph."""

    HYPER = {**UMAPModel.HYPER, "max_iter": 100, "learning_rate": 1.0, "negative_sample_rate": 5}
    VERBS = UMAPModel.VERBS

    def _train(self, df: DataFrame) -> Fitted:
        k = self.setting("n_neighbors")
        finder, found, n = self._search(df, k)
        if n < 2:
            raise ValueError("UMAP needs at least two rows")
        one_way = neighbour_weights(found, k, umap_weights, True)
        # fuzzy union p + q - pq of the two directions; an edge known one way keeps its weight
        total, squares = F.sum("w"), F.sum(F.col("w") * F.col("w"))
        edges = both_ways(one_way).groupBy("i", "j").agg((total - (total * total - squares) / 2.0).alias("w"))
        edges = settle(edges, "graph")
        a, b = curve(self.setting("min_dist"), self.setting("spread"))
        epochs, rate, negatives = self.setting("max_iter"), self.setting("learning_rate"), self.setting("negative_sample_rate")
        mean_strength = edges.agg(F.sum("w")).head()[0] / n

        def attract(d2):
            d2 = F.greatest(d2, F.lit(1e-12))
            return F.least(F.lit(2.0 * a * b) * F.pow(d2, F.lit(b - 1.0)) / (F.lit(1.0) + F.lit(a) * F.pow(d2, F.lit(b))),
                           F.lit(4.0) / F.sqrt(d2))

        def force(s):
            s = np.maximum(s, 1e-12)
            return np.minimum(2.0 * b / ((0.001 + s) * (1.0 + a * s**b)), 4.0 / np.sqrt(s))

        def advance(epoch, pull, push, speed):
            # a step against the mean force of a node's edges cannot overshoot like their sum
            step = rate * (1.0 - epoch / epochs) * 0.4 / max(mean_strength, 1e-12)
            moves = [(f + p) * float(step) for f, p in zip(pull, push)]
            return [(F.least(F.greatest(m, F.lit(-4.0)), F.lit(4.0)), v) for m, v in zip(moves, speed)]

        positions = run_layout(
            edges, self._start(df, 3.0), self.setting("n_components"), epochs, attract, force, None,
            negatives * mean_strength / max(n - 1, 1), advance,
        )
        return UMAPModel(dict(finder.state), {"positions": positions, "points": finder.tables["points"], "nodes": finder.tables["nodes"]})

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Positions found by the layout itself."""
        return self.fit(df)._placed(df)


__all__ = ["TSNE", "UMAP", "TSNEModel", "UMAPModel"]
