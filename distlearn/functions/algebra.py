"""Matrix products and distances as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .vectors import (
    FeatureSpec,
    constant_array,
    feature_array,
    is_scalar,
    scalar_columns,
    to_lists,
    to_matrix,
)

TILE_ROWS = 256
JVM_PRODUCT_LIMIT = 512  # above this many multiplications per row, numpy over Arrow is faster


def matrix_column(apply, x: Column) -> Column:
    """``apply(rows x d matrix) -> rows x m matrix`` as an Arrow-batched column.

    Rows go through in tiles of one size, the last one padded, so that the rounding of a product
    doesn't depend on how rows fall into batches.
    """

    @arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        x = to_matrix(batch)
        tiles = [_tile(apply, x[i : i + TILE_ROWS]) for i in range(0, max(1, len(x)), TILE_ROWS)]
        return to_lists(np.concatenate(tiles))

    return run(x)


def _tile(apply, x: np.ndarray) -> np.ndarray:
    full = np.zeros((TILE_ROWS, x.shape[1]))
    full[: len(x)] = x
    return np.asarray(apply(full), dtype=np.float64)[: len(x)]


def affine(df: DataFrame, spec: FeatureSpec, weights, offset=None, invalid: str = "error") -> Column:
    """``x @ weights.T + offset`` as ARRAY<DOUBLE>; weights has one row per output."""
    weights = np.atleast_2d(np.asarray(weights, dtype=np.float64))
    offset = np.zeros(len(weights)) if offset is None else np.atleast_1d(np.asarray(offset, dtype=np.float64))
    if weights.size > JVM_PRODUCT_LIMIT:
        turned = np.ascontiguousarray(weights.T)
        return matrix_column(lambda m: m @ turned + offset, feature_array(df, spec, invalid))
    if is_scalar(df, spec) and invalid == "keep":
        return F.array(*[_products(scalar_columns(spec), w, b) for w, b in zip(weights, offset)])
    x = feature_array(df, spec, invalid)
    if is_scalar(df, spec):
        cols = scalar_columns(spec)
        return F.when(x.isNotNull(), F.array(*[_products(cols, w, b) for w, b in zip(weights, offset)]))
    return F.array(*[dot(x, w, b) for w, b in zip(weights, offset)])


def _products(cols: list[Column], w, b) -> Column:
    total = F.lit(float(b))
    for c, v in zip(cols, w):
        total = total + c * F.lit(float(v))
    return total


def dot(x: Column, w, b: float = 0.0) -> Column:
    pairs = F.zip_with(x, constant_array(w), lambda a, c: a * c)
    return F.aggregate(pairs, F.lit(float(b)), lambda acc, v: acc + v)


def arg_max(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of two bounded blocks."""
    out = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
    out -= 2.0 * (a @ b.T)
    return np.maximum(out, 0.0, out=out)
