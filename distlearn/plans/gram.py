"""Distributed sums: moments of columns and Gram matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import FeatureSpec, feature_vector, is_scalar, scalar_columns, to_lists, to_matrix

MAX_GRAM_WIDTH = 4096  # a width x width matrix of doubles reaches the driver: 128 MiB at most
BASIS_NUMBERS = 1 << 23  # of the directions kept by the iteration for wider rows, and as many of their images


def column_moments(df: DataFrame, spec: FeatureSpec, *names: str) -> dict[str, np.ndarray | int]:
    """Per-feature ``mean``, ``std`` (population), ``min``, ``max`` and the ``count``: one aggregate."""
    if is_scalar(df, spec):
        call = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
        cols = scalar_columns(spec)
        picks = [call[n](c) for n in names for c in cols]
        row = df.agg(F.count(F.lit(1)), *picks).head()
        d, n = len(cols), row[0]
        out = {name: row[1 + i * d : 1 + (i + 1) * d] for i, name in enumerate(names)}
    else:
        asked = ["variance" if name == "std" else name for name in names]
        stats = Summarizer.metrics("count", *asked).summary(feature_vector(df, spec, "keep"))
        try:
            row = df.agg(stats.alias("s")).head()["s"]
        except Py4JJavaError as failed:
            if "Nothing has been added" not in str(failed):
                raise
            raise ValueError("cannot fit on an empty DataFrame") from failed
        n = row["count"]
        out = {name: row[a].toArray() for name, a in zip(names, asked)}
        if "std" in out:  # the summarizer's variance divides by n - 1
            out["std"] = np.sqrt(np.nan_to_num(out["std"]) * ((n - 1) / n))
    if not n:
        raise ValueError("cannot fit on an empty DataFrame")
    return {"count": n, **{k: np.array(v, dtype=np.float64) for k, v in out.items()}}


def vector_sum(df: DataFrame, column: str) -> np.ndarray | None:
    """Element-wise sum of an array column; partial sums are combined before the shuffle."""
    row = df.agg(Summarizer.sum(array_to_vector(F.col(column))).alias("s")).head()
    return None if row["s"] is None or not row["s"].size else row["s"].toArray()


def cross_sums(df: DataFrame, columns: list[Column], build: Callable, size: int) -> np.ndarray:
    """Sum over all rows of ``z vᵀ`` where ``build(*arrow_columns)`` gives the matrices (z, v).

    Each task keeps one matrix with ``size`` rows; equal matrix rows meet in a grouped sum.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                left, right = build(*batch.columns)
                part = left.T @ right
                total = part if total is None else total + part
        if total is not None:
            rows = pa.array(np.arange(len(total), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([rows, to_lists(total)], ["i", "row"])

    picked = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    parts = picked.mapInArrow(partial, "i int, row array<double>")
    merged = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).collect()
    if not merged:
        raise ValueError("cannot fit on an empty DataFrame")
    return np.array([r["row"].toArray() for r in sorted(merged, key=lambda r: r["i"])])


def gram(df: DataFrame, columns: list[Column], build: Callable, size: int) -> np.ndarray:
    """Sum over all rows of ``z zᵀ``."""
    if size > MAX_GRAM_WIDTH + 2:
        raise ValueError(f"width {size} is above {MAX_GRAM_WIDTH}; use an iterative solver")

    def both(*batch):
        z = build(*batch)
        return z, z

    return cross_sums(df, columns, both, size)


def row_sums(df: DataFrame, columns: list[Column], build: Callable) -> np.ndarray:
    """Sum over all batches of the short vector ``build(*arrow_columns)``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(build(*b.columns) for b in batches if b.num_rows)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([to_lists(total[None, :])], ["sums"])

    picked = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return vector_sum(picked.mapInArrow(partial, "sums array<double>"), "sums")


def centred_gram(df: DataFrame, x: Column, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and centred scatter matrix in one pass.

    Rows are shifted by one data row first, so the subtraction loses no digits.
    """
    first = df.select(x.alias("x")).head()
    if first is None:
        raise ValueError("cannot fit on an empty DataFrame")
    shift = np.array(first["x"], dtype=np.float64)

    def build(batch):
        m = to_matrix(batch, d) - shift
        return np.hstack([np.ones((len(m), 1)), m])

    g = gram(df, [x], build, d + 1)
    n, total = g[0, 0], g[0, 1:]
    return int(round(n)), shift + total / n, g[1:, 1:] - np.outer(total, total) / n


def leading_subspace(df: DataFrame, x: Column, d: int, k: int, mean: np.ndarray, passes: int = 300, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the scatter around ``mean`` and their vectors as rows, for any width.

    Block Lanczos with full orthogonalisation and thick restarts: each pass multiplies one block of k + 10 directions with
    all rows, so no d x d matrix is ever made. It ends when every wanted pair has a residual ``|A v - l v|`` below ``tol``
    times the largest eigenvalue, and raises ValueError if that takes more than ``passes``.
    """
    r = min(d, k + 10)
    most = min(d, max(4 * r, BASIS_NUMBERS // d))
    rng = np.random.default_rng(0)
    block = np.linalg.qr(rng.standard_normal((d, r)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(passes):

        def build(batch, block=block):
            m = to_matrix(batch, d) - mean
            return m, m @ block

        basis, image = np.hstack([basis, block]), np.hstack([image, cross_sums(df, [x], build, d)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        off = image @ turn[:, :r] - (basis @ turn[:, :r]) * values[:r]
        worst = np.linalg.norm(off[:, :k], axis=0).max() / max(values[0], 1e-300)
        if worst <= tol or basis.shape[1] == d:
            return np.maximum(values[:k], 0.0), (basis @ turn[:, :k]).T
        if basis.shape[1] + r > most:
            kept = turn[:, : max(2 * r, most // 2)]
            basis, image = basis @ kept, image @ kept
        block = (off / np.maximum(np.linalg.norm(off, axis=0), 1e-300))[:, : d - basis.shape[1]]
        for _ in range(3):  # directions that have converged leave only noise, which must be turned away again
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    raise ValueError(f"the leading {k} directions have a residual of {worst:.1e} after {passes} passes; ask for fewer or more of them")
