"""Feature columns: one canonical form (ARRAY<DOUBLE>) whatever the caller stores.

Features may be given as a vector column, an array column, one numeric column or a
list of numeric columns. Lists of scalar columns stay plain expressions, so column
pruning and whole-stage codegen reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FeatureSpec = str | Sequence[str]


def column_names(spec: FeatureSpec) -> list[str]:
    return [spec] if isinstance(spec, str) else list(spec)


def is_scalar(df: DataFrame, spec: FeatureSpec) -> bool:
    """True when the features are separate numeric columns."""
    return all(isinstance(df.schema[c].dataType, T.NumericType) for c in column_names(spec))


def scalar_columns(spec: FeatureSpec) -> list[Column]:
    return [F.col(c).cast("double") for c in column_names(spec)]


def check_features(df: DataFrame, spec: FeatureSpec) -> None:
    """Schema check before any job starts."""
    names = column_names(spec)
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"feature columns not found: {missing}; have {df.columns}")
    if is_scalar(df, spec):
        return
    kind = df.schema[names[0]].dataType
    is_array = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)
    if len(names) > 1 or not (is_array or isinstance(kind, VectorUDT)):
        raise TypeError(f"features must be numeric columns, one array or one vector: {names}")


def feature_array(df: DataFrame, spec: FeatureSpec, invalid: str = "error") -> Column:
    """The features as ARRAY<DOUBLE>; a null feature raises unless ``invalid`` is keep/skip."""
    check_features(df, spec)
    if is_scalar(df, spec):
        cols = scalar_columns(spec)
        arr, empty = F.array(*cols), F.lit(False)
        for c in cols:
            empty = empty | c.isNull()
    else:
        name = column_names(spec)[0]
        raw = F.col(name)
        if isinstance(df.schema[name].dataType, VectorUDT):
            arr, empty = vector_to_array(raw), raw.isNull()
        else:
            arr = raw.cast("array<double>")
            empty = raw.isNull()
            if df.schema[name].dataType.containsNull:
                empty = empty | F.exists(arr, lambda v: v.isNull())
    if invalid == "error":
        return F.when(empty, F.raise_error(F.lit("null in features"))).otherwise(arr)
    return F.when(~empty, arr)


def feature_vector(df: DataFrame, spec: FeatureSpec, invalid: str = "error") -> Column:
    names = column_names(spec)
    if len(names) == 1 and isinstance(df.schema[names[0]].dataType, VectorUDT) and invalid != "error":
        return F.col(names[0])
    return array_to_vector(feature_array(df, spec, invalid))


def drop_invalid(df: DataFrame, spec: FeatureSpec, label: str | None = None) -> DataFrame:
    """Rows with complete features (and label): the ``skip`` policy."""
    kept = df.where(feature_array(df, spec, "skip").isNotNull())
    return kept.where(F.col(label).isNotNull()) if label else kept


def width(df: DataFrame, spec: FeatureSpec) -> int:
    """Number of features: from the schema if possible, else from one row."""
    if is_scalar(df, spec):
        return len(column_names(spec))
    row = df.select(F.size(feature_array(df, spec)).alias("d")).head()
    if row is None:
        raise ValueError("cannot fit on an empty DataFrame")
    return row["d"]


def to_matrix(arr: pa.Array, d: int | None = None) -> np.ndarray:
    """Arrow list array -> (rows, d) float64 matrix without a per-row loop."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.empty((0, d or 0))
    if arr.null_count:
        raise ValueError("null feature array")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    wide = d or len(flat) // n
    lengths = np.diff(arr.offsets.to_numpy())
    if not (lengths == wide).all():
        raise ValueError(f"feature arrays differ in length; expected {wide}")
    return flat.reshape(n, wide)


def to_lists(matrix: np.ndarray) -> pa.ListArray:
    n, d = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def constant_array(values) -> Column:
    """A literal ARRAY<DOUBLE>, parsed in one call and folded to a constant."""
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")
