"""Random forests: Spark's distributed trees behind the common verbs."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier as SparkForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor as SparkForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Fitted, Learner, class_list, class_metadata, label_index, label_value
from ..functions.vectors import feature_vector
from ..plans.spread import over_all_cores

MAX_TREE_DEPTH = 30  # Spark's limit


class _ForestModel(Fitted):
    VERBS = frozenset({"fit", "predict", "score"})

    def _raw(self, df: DataFrame) -> DataFrame:
        x = feature_vector(df, self.setting("features_col"), self.setting("handle_invalid"))
        return self.native["forest"].transform(df.withColumn("_forest_x", x))


class ForestClassifierModel(_ForestModel):
    KIND = "classifier"

    def _predict(self, df: DataFrame) -> DataFrame:
        value = label_value(F.col("_forest_class"), self.state["classes"])
        out = self._raw(df).withColumn(self.setting("prediction_col"), value)
        return out.select(*[c for c in df.columns if c != self.setting("prediction_col")], self.setting("prediction_col"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        df = self._input(df)
        out = self._raw(df).withColumn(self.setting("output_col"), vector_to_array("_forest_p"))
        return out.select(*df.columns, self.setting("output_col"))


class ForestRegressorModel(_ForestModel):
    def _predict(self, df: DataFrame) -> DataFrame:
        out = self._raw(df).withColumn(self.setting("prediction_col"), F.col("_forest_value"))
        return out.select(*[c for c in df.columns if c != self.setting("prediction_col")], self.setting("prediction_col"))


class _Forest(Learner):
    HYPER = {
        "n_estimators": 100,
        "max_depth": 16,
        "max_features": "auto",
        "n_bins": 128,
        "min_samples_leaf": 1,
        "bootstrap": True,
        "random_state": 0,
        "output_col": "probability",
    }
    VERBS = _ForestModel.VERBS
    SUPERVISED = True

    def _grow(self, algorithm, df: DataFrame, label, metadata: dict | None = None, **columns):
        depth = self.setting("max_depth")
        if not 0 <= depth <= MAX_TREE_DEPTH:
            raise ValueError(f"max_depth={depth} must be between 0 and {MAX_TREE_DEPTH}")
        x = feature_vector(df, self.setting("features_col"), self.setting("handle_invalid"))
        solver = algorithm(
            featuresCol="_forest_x",
            labelCol="_forest_y",
            numTrees=self.setting("n_estimators"),
            maxDepth=depth,
            maxBins=self.setting("n_bins"),
            minInstancesPerNode=self.setting("min_samples_leaf"),
            featureSubsetStrategy=str(self.setting("max_features")),
            bootstrap=self.setting("bootstrap"),
            seed=self.setting("random_state"),
            **columns,
        )
        return solver.fit(over_all_cores(df.select(x.alias("_forest_x"), label.alias("_forest_y", metadata=metadata or {}))))


class RandomForestClassifier(_Forest):
    """Bagged classification trees with histogram splits."""

    def _train(self, df: DataFrame) -> Fitted:
        classes = class_list(df, self.setting("label_col"))
        forest = self._grow(
            SparkForestClassifier, df, label_index(self.setting("label_col"), classes),
            metadata=class_metadata(classes), predictionCol="_forest_class", probabilityCol="_forest_p", rawPredictionCol="_forest_raw",
        )
        return ForestClassifierModel({"classes": classes}, {}, {"forest": forest})


class RandomForestRegressor(_Forest):
    """Bagged regression trees with histogram splits."""

    def _train(self, df: DataFrame) -> Fitted:
        label = F.col(self.setting("label_col")).cast("double")
        forest = self._grow(SparkForestRegressor, df, label, predictionCol="_forest_value")
        return ForestRegressorModel({}, {}, {"forest": forest})
