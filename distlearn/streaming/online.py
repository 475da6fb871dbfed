"""Mini-batch SGD over a stream: one step per micro-batch."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import feature_array
from ..operators.linear import LinearModel
from ..operators.solvers import gradient_sums, sgd_step


class OnlineRegression:
    """Linear regression trained by ``foreachBatch``.

    The weights after batch b are written under ``folder/batch=b``, and batch b + 1 reads only that. A replayed batch starts
    from the weights of the batch before it and overwrites its own, so replays change nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, features, label: str, rate: float = 0.1, alpha: float = 0.0):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.features, self.label, self.rate, self.alpha = features, label, rate, alpha

    def _weights(self, batch: int | None = None) -> np.ndarray | None:
        """Weights after a batch; without one, after the last."""
        try:
            if batch is not None:
                table = self.spark.read.parquet(f"{self.folder}/batch={batch}")
            else:
                table = self.spark.read.parquet(self.folder).orderBy(F.desc("batch"))
        except AnalysisException:
            return None
        row = table.select("weights").head()
        return np.array(row["weights"]) if row and row["weights"] else None

    def step(self, rows: DataFrame, batch: int) -> None:
        part = rows.select(
            feature_array(rows, self.features).alias("x"), F.col(self.label).cast("double").alias("y")
        )
        first = part.select(F.size("x")).head()
        weights, count = self._weights(batch - 1) if batch else None, 0
        if first is not None:
            weights = np.zeros(first[0] + 1) if weights is None else weights
            sums = gradient_sums(part, weights, "squared_loss")
            weights, count = sgd_step(weights, sums, self.rate, "l2", self.alpha, 0.0), int(sums[-1])
        known = [] if weights is None else weights.tolist()  # an empty batch hands the weights on
        out = self.spark.createDataFrame([(known, count)], "weights array<double>, n_rows long")
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def train(self, stream: DataFrame, progress: str) -> None:
        """Run over everything that has arrived."""
        query = (
            stream.writeStream.foreachBatch(self.step).option("checkpointLocation", progress)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def model(self) -> LinearModel:
        weights = self._weights()
        if weights is None:
            raise ValueError("no batch has been trained yet")
        fitted = LinearModel({"coef": weights[:-1], "intercept": float(weights[-1])})
        fitted._set(features_col=self.features, label_col=self.label)
        return fitted
