"""Kernel classifier and regressor by a Nyström feature map and linear training.

An exact kernel solver needs all pairs of rows. Here m landmark rows (chosen by a hash of
the row id) give an explicit feature map whose inner products approximate the kernel
(Williams & Seeger 2001); training on it is a sum over rows per step. With every distinct
row as landmark the map is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Fitted, Learner, class_list, label_index, label_value
from ..functions.algebra import affine, arg_max, matrix_column, squared_distances
from ..functions.vectors import to_matrix, width
from ..plans.cells import draw_rows
from ..plans.gram import column_moments, cross_sums, gram, row_sums
from ..plans.spread import over_all_cores


def kernel_block(settings: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind, gamma = settings["kernel"], settings["gamma"]
    if kind == "rbf":
        return np.exp(-gamma * squared_distances(a, b))
    if kind == "poly":
        return (gamma * (a @ b.T) + settings["coef0"]) ** settings["degree"]
    if kind == "sigmoid":
        return np.tanh(gamma * (a @ b.T) + settings["coef0"])
    raise ValueError(f"unknown kernel {kind!r}; use linear, rbf, poly or sigmoid")


def kernel_map(state: dict):
    """rows x d -> rows x r with inner products close to the kernel."""
    if state["kernel"] == "linear":
        return lambda x: x
    landmarks, root = state["landmarks"], state["root"]
    settings = {k: state[k] for k in ("kernel", "gamma", "coef0", "degree")}
    return lambda x: kernel_block(settings, x, landmarks) @ root


class _KernelModel(Fitted):
    """state: kernel settings, landmarks, root, coef (rows x r), intercept (rows)."""

    VERBS = frozenset({"fit", "predict", "score"})

    def _values(self, df: DataFrame):
        spec, invalid = self.setting("features_col"), self.setting("handle_invalid")
        coef, intercept = self.state["coef"], self.state["intercept"]
        if self.state["kernel"] == "linear":
            return affine(df, spec, coef, intercept, invalid)
        lift = kernel_map(self.state)
        return matrix_column(lambda x: lift(x) @ coef.T + intercept, self._x(df))


class _KernelLearner(Learner):
    HYPER = {
        "kernel": "rbf",
        "C": 1.0,
        "gamma": "scale",
        "degree": 3,
        "coef0": 0.0,
        "n_landmarks": 256,
        "max_iter": 200,
        "tol": 1e-6,
        "random_state": 0,
    }
    VERBS = _KernelModel.VERBS
    SUPERVISED = True

    def _lift(self, df: DataFrame, d: int) -> dict:
        """Kernel settings and the feature map; at most n_landmarks rows reach the driver."""
        s = {k: self.setting(k) for k in ("kernel", "gamma", "degree", "coef0")}
        if s["kernel"] == "linear":
            return {**s, "gamma": 0.0}
        if s["gamma"] == "scale":
            stats = column_moments(df, self.setting("features_col"), "mean", "std")
            spread = np.mean(stats["std"] ** 2) + np.var(stats["mean"])
            s["gamma"] = 1.0 / (d * spread) if spread > 0 else 1.0
        elif s["gamma"] == "auto":
            s["gamma"] = 1.0 / d
        landmarks = draw_rows(
            df.select(self._x(df).alias("x")), self.setting("n_landmarks"), df.count(), int(self.setting("random_state")), exact=True
        )
        values, vectors = np.linalg.eigh(kernel_block(s, landmarks, landmarks))
        keep = values > values.max() * 1e-10
        return {**s, "landmarks": landmarks, "root": vectors[:, keep] / np.sqrt(values[keep])}


class SVCModel(_KernelModel):
    KIND = "classifier"

    def _predict(self, df: DataFrame) -> DataFrame:
        values, classes = self._values(df), self.state["classes"]
        index = F.when(values[0] > 0, 1).otherwise(0) if len(classes) == 2 else arg_max(values)
        return df.withColumn(self.setting("prediction_col"), label_value(index, classes))

    def decision_function(self, df: DataFrame) -> DataFrame:
        return self._input(df).withColumn(self.setting("output_col"), self._values(df))


class SVC(_KernelLearner):
    """Hinge loss, ``C * sum(loss) + |w|^2 / 2``; more than two classes one against the rest.

    The kink of the hinge is rounded over a width that shrinks to ``smoothing`` (Chapelle
    2007), which gives Newton rounds: about ten passes over the rows instead of hundreds,
    with a loss within smoothing / 4 of the hinge.
    """

    HYPER = {"smoothing": 0.1, "max_iter": 40, "tol": 1e-3}

    def _train(self, df: DataFrame) -> Fitted:
        d = width(df, self.setting("features_col"))
        classes = class_list(df, self.setting("label_col"))
        state = self._lift(df, d)
        r = d if state["kernel"] == "linear" else state["root"].shape[1]
        rows = df.select(self._x(df).alias("x"), label_index(self.setting("label_col"), classes).alias("class"))
        rows = over_all_cores(rows).persist()
        try:
            targets = [1] if len(classes) == 2 else range(len(classes))
            coef = np.array([self._separate(rows, t, d, r, kernel_map(state)) for t in targets])
        finally:
            rows.unpersist()
        return SVCModel({**state, "coef": coef[:, :-1], "intercept": coef[:, -1], "classes": classes})

    def _separate(self, rows: DataFrame, target: int, d: int, r: int, lift) -> np.ndarray:
        c, columns = self.setting("C"), [F.col("x"), F.col("class")]
        penalty = np.append(np.ones(r), 1e-8)
        w, h, h_last = np.zeros(r + 1), 1.0, self.setting("smoothing")

        def read(xs, ys):
            z = np.hstack([lift(to_matrix(xs, d)), np.ones((len(xs), 1))])
            return z, np.where(ys.to_numpy(zero_copy_only=False) == target, 1.0, -1.0)

        for _ in range(self.setting("max_iter")):

            def curvature(xs, ys, w=w, h=h):
                z, y = read(xs, ys)
                short = 1.0 - y * (z @ w)  # distance below the margin
                bent = np.abs(short) <= h
                slope = -y * np.where(short > h, 1.0, np.where(bent, (short + h) / (2.0 * h), 0.0))
                return z, np.hstack([z * (bent / (2.0 * h))[:, None], slope[:, None]])

            # left block: second derivative; last column: first derivative
            sums = cross_sums(rows, columns, curvature, r + 1)
            move = np.linalg.solve(c * sums[:, :-1] + np.diag(penalty), -(penalty * w + c * sums[:, -1]))

            def losses(xs, ys, w=w, h=h, move=move):
                z, y = read(xs, ys)
                short = 1.0 - y[:, None] * ((z @ w)[:, None] + (z @ move)[:, None] * STEPS)
                bent = (short + h) ** 2 / (4.0 * h)
                return np.where(short > h, short, np.where(short < -h, 0.0, bent)).sum(axis=0)

            totals = c * row_sums(rows, columns, losses)
            totals += 0.5 * (penalty[:, None] * (w[:, None] + move[:, None] * STEPS) ** 2).sum(axis=0)
            best = int(totals.argmin())
            gain = (totals[-1] - totals[best]) / max(abs(totals[-1]), 1e-300)
            w = w + STEPS[best] * move
            if gain < self.setting("tol") or STEPS[best] == 0.0:
                if h <= h_last:
                    break
                h = max(h / 3.0, h_last)
        return w


# step lengths tried together in one pass; the last one is the present point
STEPS = np.array([1.0, 0.6, 0.35, 0.2, 0.1, 0.03, 0.01, 0.0])


class SVRModel(_KernelModel):
    def _predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.setting("prediction_col"), self._values(df)[0])


class SVR(_KernelLearner):
    """``|w|^2/2 + C * sum(max(0, |y - f(x)| - epsilon)^2)`` by active-set Newton (Chapelle 2007).

    ``n_landmarks`` bounds the basis of the function, not the rows: all rows enter the loss.

    Each round is one weighted Gram aggregate over the rows outside the epsilon tube.
    """

    HYPER = {"epsilon": 0.1, "max_iter": 20}

    def _train(self, df: DataFrame) -> Fitted:
        d = width(df, self.setting("features_col"))
        state = self._lift(df, d)
        lift, eps, c = kernel_map(state), self.setting("epsilon"), self.setting("C")
        r = d if state["kernel"] == "linear" else state["root"].shape[1]
        columns = [self._x(df), F.col(self.setting("label_col")).cast("double")]
        rows = over_all_cores(df.select(columns[0].alias("x"), columns[1].alias("y"))).persist()
        try:
            w, before = None, None
            for _ in range(self.setting("max_iter")):

                def build(xs, ys, w=w):
                    z = np.hstack([lift(to_matrix(xs, d)), np.ones((len(xs), 1))])
                    y = ys.to_numpy(zero_copy_only=False)
                    if w is None:
                        return np.hstack([z, y[:, None]])
                    gap = y - z @ w
                    active = np.abs(gap) > eps
                    moved = y[active] - eps * np.sign(gap[active])
                    return np.hstack([z[active], moved[:, None]])

                g = gram(rows, [F.col("x"), F.col("y")], build, r + 2)
                penalty = np.append(np.ones(r), 1e-12)
                w = np.linalg.solve(2.0 * c * g[:-1, :-1] + np.diag(penalty), 2.0 * c * g[:-1, -1])
                if before is not None and np.abs(w - before).max() <= self.setting("tol") * (1 + np.abs(w).max()):
                    break
                before = w
        finally:
            rows.unpersist()
        return SVRModel({**state, "coef": w[None, :-1], "intercept": w[-1:]})
