"""K-means and density clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans as SparkKMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Fitted, Learner
from ..functions.algebra import matrix_column, squared_distances
from ..functions.vectors import feature_vector, to_matrix, width
from ..plans.cells import CELL_ROWS
from ..plans.density import density_clusters
from ..plans.gram import cross_sums
from ..plans.lineage import settle
from ..plans.spread import over_all_cores
from .neighbors import keyed_points


def centre_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    origin = centres.mean(axis=0)
    return squared_distances(x - origin, centres - origin)


class KMeansModel(Fitted):
    """state: centres (k x d), cost, rounds."""

    HYPER = {"output_col": "distances"}
    VERBS = frozenset({"fit", "predict", "transform", "fit_transform", "fit_predict", "score"})

    def _predict(self, df: DataFrame) -> DataFrame:
        centres = self.state["centres"]
        value = matrix_column(
            lambda x: centre_distances(x, centres).argmin(axis=1)[:, None].astype(np.float64), self._x(df)
        )[0]
        return df.withColumn(self.setting("prediction_col"), value.cast("int"))

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds the prediction and the distance to every centre."""
        df, centres = self._input(df), self.state["centres"]
        to = matrix_column(lambda x: np.sqrt(centre_distances(x, centres)), self._x(df))
        out = df.withColumn(self.setting("output_col"), to)
        lowest = F.array_position(self.setting("output_col"), F.array_min(self.setting("output_col"))) - 1
        return out.withColumn(self.setting("prediction_col"), lowest.cast("int"))

    def score(self, df: DataFrame) -> float:
        """Negative sum of squared distances to the nearest centre."""
        df, centres = self._input(df), self.state["centres"]
        least = matrix_column(lambda x: centre_distances(x, centres).min(axis=1)[:, None], self._x(df))[0]
        return -df.agg(F.sum(least)).head()[0]


class KMeans(Learner):
    """``init='k-means||'`` runs Spark's k-means; a list of centres runs plain Lloyd rounds from them."""

    HYPER = {
        **KMeansModel.HYPER,
        "n_clusters": 8,
        "init": "k-means||",
        "max_iter": 300,
        "tol": 1e-4,
        "random_state": 0,
    }
    VERBS = KMeansModel.VERBS

    def _train(self, df: DataFrame) -> Fitted:
        if self.setting("init") != "k-means||":
            return self._lloyd(df)
        x = feature_vector(df, self.setting("features_col"), self.setting("handle_invalid"))
        solver = SparkKMeans(
            k=self.setting("n_clusters"), seed=self.setting("random_state"), maxIter=self.setting("max_iter"),
            tol=self.setting("tol"), initMode="k-means||",
        )
        fitted = solver.fit(over_all_cores(df.select(x.alias("features"))))
        return KMeansModel(
            {"centres": np.array(fitted.clusterCenters()), "cost": fitted.summary.trainingCost,
             "rounds": fitted.summary.numIter}
        )

    def _lloyd(self, df: DataFrame) -> Fitted:
        centres = np.array(self.setting("init"), dtype=np.float64)
        d, k = width(df, self.setting("features_col")), len(centres)
        if centres.ndim != 2 or centres.shape[1] != d or k != self.setting("n_clusters"):
            raise ValueError(f"init must be n_clusters x {d} numbers, got shape {centres.shape}")
        rows = over_all_cores(df.select(self._x(df).alias("x"))).persist()
        try:
            cost, done = 0.0, 0
            for done in range(1, self.setting("max_iter") + 1):
                sums = cross_sums(rows, [F.col("x")], _assigner(centres, d), k)
                counts, cost = sums[:, d], sums[:, d + 1].sum()
                moved = np.where(counts[:, None] > 0, sums[:, :d] / np.maximum(counts, 1)[:, None], 0.0)
                # sums are taken around the old centre; an empty cluster keeps its centre
                shift = ((moved) ** 2).sum(axis=1).max()
                centres = centres + moved
                if shift <= self.setting("tol") ** 2:
                    break
        finally:
            rows.unpersist()
        return KMeansModel({"centres": centres, "cost": float(cost), "rounds": done})


def _assigner(centres: np.ndarray, d: int):
    """One row per cluster: sum of offsets from its centre, row count, squared distances."""

    def build(batch: pa.Array):
        x = to_matrix(batch, d)
        away = centre_distances(x, centres)
        near = away.argmin(axis=1)
        member = np.zeros((len(x), len(centres)))
        member[np.arange(len(x)), near] = 1.0
        offset = x - centres[near]
        return member, np.hstack([offset, np.ones((len(x), 1)), (offset**2).sum(axis=1)[:, None]])

    return build


class DBSCANModel(Fitted):
    """tables: labels (id, cluster)."""

    VERBS = frozenset({"predict"})

    def _predict(self, df: DataFrame) -> DataFrame:
        """Clusters of the fitted rows, found by id."""
        key = self.setting("id_col")
        labels = self.tables["labels"].select(
            F.col("id").alias(key), F.col("cluster").cast("long").alias(self.setting("prediction_col"))
        )
        return df.drop(self.setting("prediction_col")).join(labels, key)


class DBSCAN(Learner):
    """Clusters of rows with at least ``min_samples`` rows (themselves included) within ``eps``.

    Border rows join the smallest cluster in reach; noise is -1; clusters are numbered by
    their smallest core id.
    """

    HYPER = {"eps": 0.5, "min_samples": 5, "cell_rows": CELL_ROWS}
    VERBS = frozenset({"fit_predict"})

    def fit_predict(self, df: DataFrame) -> DataFrame:
        self._need("fit_predict")
        df = self._rows(df, False)
        found = density_clusters(
            keyed_points(df, self), float(self.setting("eps")), self.setting("min_samples"), self.setting("cell_rows")
        )
        self.model_ = self._give(DBSCANModel({}, {"labels": settle(found, "labels")}))
        return self.model_.predict(df)
