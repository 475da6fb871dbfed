"""Data makers: values drawn from a hash of (seed, row id, feature), whatever the partitioning.

Each maker takes a row count or a DataFrame whose id column says which rows to draw.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import dot
from ..functions.draws import bucket, normal, uniform


def _ids(source, spark: SparkSession | None, id_col: str) -> DataFrame:
    if isinstance(source, DataFrame):
        return source.select(F.col(id_col).cast("long").alias("id"))
    return (spark or SparkSession.active()).range(int(source))


def _matrix(n_features: int, seed: int, kind: str = "normal") -> Column:
    draw = {"normal": normal, "uniform": uniform}[kind]
    streams = F.sequence(F.lit(0), F.lit(n_features - 1))
    if kind == "normal":
        radius = lambda j: F.sqrt(F.lit(-2.0) * F.log(uniform(F.col("id"), seed, 2 * j)))
        return F.transform(streams, lambda j: radius(j) * F.cos(F.lit(2 * np.pi) * uniform(F.col("id"), seed, 2 * j + 1)))
    return F.transform(streams, lambda j: draw(F.col("id"), seed, j))


def make_gaussian(source, n_features: int = 20, seed: int = 42, kind: str = "normal", spark=None, id_col="id"):
    """Standard normal (or uniform) features: columns id, features."""
    return _ids(source, spark, id_col).withColumn("features", _matrix(n_features, seed, kind))


def make_regression(source, n_features=20, noise=0.1, seed=42, kind="normal", spark=None, id_col="id"):
    """``label = X w + noise`` with normal w."""
    weights = np.random.default_rng(seed).normal(size=n_features)
    df = make_gaussian(source, n_features, seed, kind, spark, id_col)
    label = dot(F.col("features"), weights)
    if noise:
        label = label + F.lit(float(noise)) * normal(F.col("id"), seed, 1_000_000)
    return df.withColumn("label", label)


def make_classification(source, n_features=20, n_classes=2, seed=42, spark=None, id_col="id"):
    """Two classes split at feature 0 > 0, or three at ±0.5."""
    df = make_gaussian(source, n_features, seed, "normal", spark, id_col)
    first = F.col("features")[0]
    if n_classes == 2:
        label = (first > 0).cast("int")
    elif n_classes == 3:
        label = F.when(first > 0.5, 1).when(first < -0.5, 2).otherwise(0)
    else:
        raise ValueError("n_classes must be 2 or 3")
    return df.withColumn("label", label)


def make_blobs(source, n_features=20, spread=0.4, seed=42, distance=4.0, spark=None, id_col="id"):
    """Three round clusters: around (4, 4, 0, ...), (-4, -4, 0, ...) and 0."""
    df = make_gaussian(source, n_features, seed, "normal", spark, id_col)
    df = df.withColumn("blob", bucket(F.col("id"), seed, 3, 2_000_000).cast("int"))
    side = F.when(F.col("blob") == 0, distance).when(F.col("blob") == 1, -distance).otherwise(0.0)
    moved = F.transform("features", lambda v, j: v * spread + F.when(j < 2, side).otherwise(0.0))
    return df.withColumn("features", moved)


def make_nonnegative(source, n_features=20, seed=42, spark=None, id_col="id"):
    df = make_gaussian(source, n_features, seed, "normal", spark, id_col)
    return df.withColumn("features", F.transform("features", lambda v: F.abs(v) + 0.01))
