"""Solvers on small summaries: the data are read once (or once per step) by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import bucket
from ..functions.vectors import to_lists, to_matrix, width
from ..plans.gram import centred_gram, vector_sum
from ..plans.spread import over_all_cores


def regression_moments(df: DataFrame, x: Column, label: str, spec) -> dict:
    """n, means, XᵀX and Xᵀy of centred data from one pass."""
    d = width(df, spec)
    joint = F.concat(x, F.array(F.col(label).cast("double")))
    n, mean, scatter = centred_gram(df, joint, d + 1)
    return {
        "n": n,
        "x_mean": mean[:d],
        "y_mean": mean[d],
        "xx": scatter[:d, :d],
        "xy": scatter[:d, d],
    }


def coordinate_descent(
    moments: dict, l1: float, l2: float, max_iter: int, tol: float, intercept: bool = True
) -> np.ndarray:
    """Minimise ``1/(2n) |y - Xw|^2 + l1 |w|_1 + l2/2 |w|^2`` on the Gram matrix."""
    n, xx, xy = moments["n"], moments["xx"], moments["xy"]
    if not intercept:
        xx = xx + n * np.outer(moments["x_mean"], moments["x_mean"])
        xy = xy + n * moments["x_mean"] * moments["y_mean"]
    a, b = xx / n, xy / n
    w = np.zeros(len(b))
    for _ in range(max_iter):
        largest = 0.0
        for j in range(len(w)):
            if a[j, j] + l2 == 0:
                continue
            pull = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (a[j, j] + l2)
            largest, w[j] = max(largest, abs(new - w[j])), new
        if largest <= tol * max(np.abs(w).max(), 1e-300):
            break
    return w


# d(loss)/d(score) and loss for a score s and a target y (classes as -1 / +1)
SLOPES: dict[str, Callable] = {
    "log": lambda s, y: -y / (1.0 + np.exp(np.clip(y * s, -700, 700))),
    "hinge": lambda s, y: np.where(y * s < 1.0, -y, 0.0),
    "squared_loss": lambda s, y: s - y,
}
LOSSES: dict[str, Callable] = {
    "log": lambda s, y: np.logaddexp(0.0, -y * s),
    "hinge": lambda s, y: np.maximum(0.0, 1.0 - y * s),
    "squared_loss": lambda s, y: 0.5 * (s - y) ** 2,
}


def gradient_sums(df: DataFrame, weights: np.ndarray, loss: str) -> np.ndarray | None:
    """[sum of gradient (d), sum of slopes, sum of losses, rows] over columns x, y."""
    d = len(weights) - 1
    slope, cost = SLOPES[loss], LOSSES[loss]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 3)
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column(0), d)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                s = x @ weights[:d] + weights[d]
                g = slope(s, y)
                total += np.concatenate([g @ x, [g.sum(), cost(s, y).sum(), len(y)]])
        if total[-1]:
            yield pa.RecordBatch.from_arrays([to_lists(total[None, :])], ["sums"])

    return vector_sum(df.select("x", "y").mapInArrow(partial, "sums array<double>"), "sums")


def sgd_step(weights: np.ndarray, sums: np.ndarray, rate: float, penalty: str, alpha: float, l1_ratio: float,
             intercept: bool = True) -> np.ndarray:
    """One step against the mean gradient of a batch plus the penalty's (sub)gradient."""
    n, w = sums[-1], weights[:-1]
    l1, l2 = {
        "none": (0.0, 0.0), "l1": (alpha, 0.0), "l2": (0.0, alpha),
        "elasticnet": (alpha * l1_ratio, alpha * (1.0 - l1_ratio)),
    }[penalty]
    step = np.append(sums[: len(w)] / n + l2 * w + l1 * np.sign(w), sums[len(w)] / n if intercept else 0.0)
    return weights - rate * step


def minibatch_sgd(df: DataFrame, d: int, settings: dict) -> tuple[np.ndarray, list[float]]:
    """Mini-batch gradient descent over columns ``x, y, key``.

    Epoch e splits the rows into batches by a hash of (key, seed, e); each step is one
    aggregate over its batch. The result depends on the rows, not on their partitions.
    """
    df = over_all_cores(df).persist()
    try:
        rows = df.count()
        if not rows:
            raise ValueError("cannot fit on an empty DataFrame")
        size = settings["batch_size"] or rows
        batches = max(1, -(-rows // size))
        w, history, rate, stale, best = np.zeros(d + 1), [], settings["eta0"], 0, np.inf
        steps = 0
        for epoch in range(settings["epochs"]):
            total = 0.0
            for b in range(batches):
                picked = df
                if batches > 1:
                    picked = df.where(bucket(F.col("key"), settings["random_state"], batches, epoch) == b)
                sums = gradient_sums(picked, w, settings["loss"])
                if sums is None:
                    continue
                steps += 1
                if settings["learning_rate"] == "invscaling":
                    rate = settings["eta0"] / steps ** settings["power_t"]
                w = sgd_step(w, sums, rate, settings["penalty"], settings["alpha"], settings["l1_ratio"],
                             settings["fit_intercept"])
                total += sums[-2]
            history.append(total / rows)
            stale = stale + 1 if history[-1] > best - settings["tol"] else 0
            best = min(best, history[-1])
            if stale >= settings["n_iter_no_change"]:
                if settings["learning_rate"] != "adaptive" or rate < 1e-6:
                    break
                rate, stale = rate / 5.0, 0
        return w, history
    finally:
        df.unpersist()
