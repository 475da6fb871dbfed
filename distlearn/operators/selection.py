"""Hash split, cross-validation and grid search."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..base import Learner
from ..functions.draws import BUCKETS, bucket


def train_test_split(df: DataFrame, test_size: float = 0.2, seed: int = 0, id_col: str = "id"):
    """Two parts decided by a hash of the row id: the same for every partitioning."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    held = bucket(F.col(id_col), seed, BUCKETS) < F.lit(int(test_size * BUCKETS))
    return df.where(~held), df.where(held)


def fold_column(folds: int, seed: int = 0, id_col: str = "id"):
    """0..folds-1 by a hash of the row id; usable as ``CrossValidator(foldCol=...)``."""
    return bucket(F.col(id_col), seed, folds).cast("int")


def cross_val_score(
    learner, df: DataFrame, folds: int = 5, seed: int = 0, id_col: str = "id", fold_col: str | None = None
) -> list[float]:
    """``score`` of each fold's model on the rows it did not see.

    ``learner`` is one of ours, or any Spark ML estimator (a chain, say) whose model adds
    ``prediction``; the latter needs ``label_col`` and ``classifier`` attributes of its last stage.
    """
    fold = F.col(fold_col) if fold_col else fold_column(folds, seed, id_col)
    numbered = df.withColumn("_fold", fold).persist()
    try:
        scores = []
        for f in range(folds):
            model = learner.fit(numbered.where(F.col("_fold") != f))
            scores.append(_score(model, numbered.where(F.col("_fold") == f)))
        return scores
    finally:
        numbered.unpersist()


def _score(model, df: DataFrame) -> float:
    if hasattr(model, "score"):
        return model.score(df)
    last = model.stages[-1]
    return last._score(model.transform(df))


def cross_val_report(learners: dict[str, Learner], df: DataFrame, **options) -> DataFrame:
    """(model, mean, std, scores) per learner; std is over the folds (population)."""
    rows = []
    for name, learner in learners.items():
        scores = cross_val_score(learner, df, **options)
        rows.append((name, float(np.mean(scores)), float(np.std(scores)), [float(s) for s in scores]))
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame(rows, "model string, mean double, std double, scores array<double>")


class GridSearch:
    """Tries every combination of settings by cross-validation; keeps the best, refitted on all rows."""

    def __init__(
        self, learner: Learner, grid: dict[str, list], folds: int = 5, seed: int = 0, id_col: str = "id",
        fold_col: str | None = None,
    ):
        self.learner, self.grid = learner, grid
        self.options = {"folds": folds, "seed": seed, "id_col": id_col, "fold_col": fold_col}
        self.results_: list[tuple[dict, float, float]] = []
        self.best_params_ = self.best_model_ = None

    def fit(self, df: DataFrame):
        names = sorted(self.grid)
        self.results_ = []
        df = df.persist()  # read once for all settings and folds
        try:
            for values in itertools.product(*[self.grid[n] for n in names]):
                params = dict(zip(names, values))
                scores = cross_val_score(self._with(params), df, **self.options)
                self.results_.append((params, float(np.mean(scores)), float(np.std(scores))))
            self.best_params_ = max(self.results_, key=lambda r: r[1])[0]
            self.best_model_ = self._with(self.best_params_).fit(df)
        finally:
            df.unpersist()
        return self

    def _with(self, params: dict) -> Learner:
        return self.learner.copy().set_params(**params)
