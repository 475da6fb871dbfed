"""Linear, ridge, lasso, elastic-net and logistic regression.

Spark's own solvers do the distributed work; this module maps the usual objective
functions onto Spark's parameters and keeps the coefficients as a light model whose
prediction is a plain column expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression as SparkLogistic
from pyspark.ml.regression import LinearRegression as SparkLinear
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Fitted, Learner, class_counts, class_metadata, label_index, label_value
from ..functions.algebra import affine, arg_max
from ..functions.vectors import feature_vector, width
from ..plans.gram import MAX_GRAM_WIDTH
from ..plans.spread import over_all_cores
from .solvers import coordinate_descent, regression_moments


class LinearModel(Fitted):
    """state: coef (d), intercept."""

    VERBS = frozenset({"fit", "predict", "score"})

    def _predict(self, df: DataFrame) -> DataFrame:
        spec, invalid = self.setting("features_col"), self.setting("handle_invalid")
        value = affine(df, spec, self.state["coef"][None, :], [self.state["intercept"]], invalid)[0]
        return df.withColumn(self.setting("prediction_col"), value)


class _LinearLearner(Learner):
    HYPER = {"fit_intercept": True, "max_iter": 1000, "tol": 1e-10}
    VERBS = LinearModel.VERBS
    SUPERVISED = True

    def _penalty(self) -> tuple[float, float]:
        """(l1, l2) weights of ``1/(2n) |y - Xw|^2 + l1 |w|_1 + l2/2 |w|^2`` before division by n."""
        raise NotImplementedError

    def _per_row(self, n: int) -> tuple[float, float]:
        """The penalty as it applies to the mean loss over n rows."""
        return self._penalty()

    def _scaled_penalty(self, rows: DataFrame, wide: bool) -> tuple[float, float]:
        # Spark's normal solver scales the L2 term by the population std of the label,
        # the iterative one by the sample std
        spread = F.stddev_samp("label") if wide else F.stddev_pop("label")
        stats = rows.agg(F.count("label").alias("n"), spread.alias("sd")).head()
        if not stats["n"]:
            raise ValueError("cannot fit on an empty DataFrame")
        l1, l2 = self._per_row(stats["n"])
        return l1, l2 * (stats["sd"] or 0.0)

    def _train(self, df: DataFrame) -> Fitted:
        label = F.col(self.setting("label_col")).cast("double")
        wide = width(df, self.setting("features_col")) > MAX_GRAM_WIDTH
        x = feature_vector(df, self.setting("features_col"), self.setting("handle_invalid"))
        rows = df.select(x.alias("features"), label.alias("label"))
        l1, l2 = self._scaled_penalty(rows, wide)
        strength = l1 + l2
        solver = SparkLinear(
            regParam=strength,
            elasticNetParam=l1 / strength if strength else 0.0,
            standardization=False,
            fitIntercept=self.setting("fit_intercept"),
            maxIter=self.setting("max_iter"),
            tol=self.setting("tol"),
            solver="l-bfgs" if wide else "normal",
        )
        fitted = solver.fit(rows)
        return LinearModel({"coef": fitted.coefficients.toArray(), "intercept": float(fitted.intercept)})


class LinearRegression(_LinearLearner):
    """Ordinary least squares: one pass over the rows."""

    def _scaled_penalty(self, rows, wide):
        return 0.0, 0.0


class Ridge(_LinearLearner):
    """``|y - Xw|^2 + alpha |w|^2``."""

    HYPER = {"alpha": 1.0}

    def _per_row(self, n):
        return 0.0, self.setting("alpha") / n


class _SparseLearner(_LinearLearner):
    """L1 penalties; ``solver='cd'`` runs coordinate descent on the Gram matrix."""

    HYPER = {"alpha": 1.0, "solver": "spark"}

    def _train(self, df: DataFrame) -> Fitted:
        if self.setting("solver") != "cd":
            return super()._train(df)
        moments = regression_moments(df, self._x(df), self.setting("label_col"), self.setting("features_col"))
        l1, l2 = self._penalty()
        coef = coordinate_descent(
            moments, l1, l2, self.setting("max_iter"), self.setting("tol"), self.setting("fit_intercept")
        )
        shift = moments["y_mean"] - moments["x_mean"] @ coef if self.setting("fit_intercept") else 0.0
        return LinearModel({"coef": coef, "intercept": float(shift)})


class Lasso(_SparseLearner):
    """``1/(2n) |y - Xw|^2 + alpha |w|_1``."""

    def _penalty(self):
        return self.setting("alpha"), 0.0


class ElasticNet(_SparseLearner):
    """``1/(2n) |y - Xw|^2 + alpha (r |w|_1 + (1 - r)/2 |w|^2)``."""

    HYPER = {"l1_ratio": 0.5}

    def _penalty(self):
        a, r = self.setting("alpha"), self.setting("l1_ratio")
        return a * r, a * (1.0 - r)


class ScoredClasses(Fitted):
    """A classifier with one linear score per class (or one score for two classes).

    state: coef (rows x d), intercept (rows), classes.
    """

    VERBS = frozenset({"fit", "predict", "score"})
    KIND = "classifier"

    def _scores(self, df: DataFrame):
        spec, invalid = self.setting("features_col"), self.setting("handle_invalid")
        return affine(df, spec, self.state["coef"], self.state["intercept"], invalid)

    def _predict(self, df: DataFrame) -> DataFrame:
        classes, scores = self.state["classes"], self._scores(df)
        index = F.when(scores[0] > 0, 1).otherwise(0) if len(self.state["coef"]) == 1 else arg_max(scores)
        return df.withColumn(self.setting("prediction_col"), label_value(index, classes))

    def decision_function(self, df: DataFrame) -> DataFrame:
        return self._input(df).withColumn(self.setting("output_col"), self._scores(df))


class LogisticModel(ScoredClasses):
    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Class probabilities, in class order, as ``output_col``."""
        scores = self._scores(df)
        if len(self.state["coef"]) == 1:
            p = 1.0 / (1.0 + F.exp(-scores[0]))
            out = F.array(1.0 - p, p)
        else:
            raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
            out = F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))
        return self._input(df).withColumn(self.setting("output_col"), out)


class LogisticRegression(Learner):
    """``C * sum(log loss) + |w|^2 / 2`` (penalty 'l2'), for two or more classes."""

    HYPER = {
        "penalty": "l2",
        "C": 1.0,
        "l1_ratio": 0.5,
        "fit_intercept": True,
        "max_iter": 1000,
        "tol": 1e-8,
        "output_col": "probability",
    }
    VERBS = ScoredClasses.VERBS
    SUPERVISED = True

    def _train(self, df: DataFrame) -> Fitted:
        label = self.setting("label_col")
        counts = class_counts(df, label)
        classes = list(counts)
        x = feature_vector(df, self.setting("features_col"), self.setting("handle_invalid"))
        rows = df.select(x.alias("features"), label_index(label, classes).alias("label", metadata=class_metadata(classes)))
        penalty = self.setting("penalty")
        mixing = {"l2": 0.0, "l1": 1.0, "elasticnet": self.setting("l1_ratio"), None: 0.0, "none": 0.0}[penalty]
        n = sum(counts.values()) if penalty in ("l2", "l1", "elasticnet") else 0
        solver = SparkLogistic(
            family="binomial" if len(classes) == 2 else "multinomial",
            regParam=1.0 / (self.setting("C") * n) if n else 0.0,
            elasticNetParam=mixing,
            standardization=False,
            fitIntercept=self.setting("fit_intercept"),
            maxIter=self.setting("max_iter"),
            tol=self.setting("tol"),
        )
        fitted = solver.fit(over_all_cores(rows))
        return LogisticModel(
            {
                "coef": fitted.coefficientMatrix.toArray(),
                "intercept": fitted.interceptVector.toArray(),
                "classes": classes,
            }
        )
