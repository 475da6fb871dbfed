"""Mini-batch SGD classifier and regressor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Fitted, Learner, class_list
from ..functions.vectors import width
from .linear import LinearModel, ScoredClasses
from .solvers import minibatch_sgd


class _SGD(Learner):
    HYPER = {
        "loss": "squared_loss",
        "penalty": "l2",
        "alpha": 0.0001,
        "l1_ratio": 0.15,
        "fit_intercept": True,
        "epochs": 100,
        "batch_size": None,  # rows per step; None = all rows, one distributed pass per step
        "eta0": 0.1,
        "learning_rate": "constant",
        "power_t": 0.5,
        "tol": 1e-5,
        "n_iter_no_change": 5,
        "random_state": 0,
    }
    VERBS = frozenset({"fit", "predict", "score"})
    SUPERVISED = True

    def _descend(self, df: DataFrame, target):
        # batches are drawn by row id, so they do not depend on the partitioning
        if self.setting("batch_size") and self.setting("id_col") not in df.columns:
            raise ValueError(f"mini-batches are drawn by row id; column {self.setting('id_col')!r} not found")
        key = F.col(self.setting("id_col")) if self.setting("batch_size") else F.lit(0)
        rows = df.select(self._x(df).alias("x"), target.cast("double").alias("y"), key.alias("key"))
        return minibatch_sgd(rows, width(df, self.setting("features_col")), self.get_params())


class MBSGDRegressor(_SGD):
    """Linear regression by mini-batch gradient descent (squared loss)."""

    def _train(self, df: DataFrame) -> Fitted:
        w, history = self._descend(df, F.col(self.setting("label_col")))
        return LinearModel({"coef": w[:-1], "intercept": float(w[-1]), "losses": history})


class MBSGDClassifier(_SGD):
    """Two-class linear classifier by mini-batch gradient descent (hinge, log or squared loss)."""

    HYPER = {"loss": "hinge"}

    def _train(self, df: DataFrame) -> Fitted:
        label = self.setting("label_col")
        classes = class_list(df, label)
        if len(classes) != 2:
            raise ValueError(f"MBSGDClassifier takes two classes, found {len(classes)}")
        w, history = self._descend(df, F.when(F.col(label) == F.lit(classes[1]), 1.0).otherwise(-1.0))
        return ScoredClasses({"coef": w[None, :-1], "intercept": w[-1:], "classes": classes, "losses": history})
