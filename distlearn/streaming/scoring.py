"""Models applied to streams and in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udf

from ..functions.vectors import to_lists, to_matrix
from ..operators.clustering import KMeansModel, centre_distances
from ..operators.decomposition import _ProjectionModel
from ..operators.linear import LinearModel, ScoredClasses
from ..operators.preprocessing import _ScalerModel
from ..operators.svm import SVCModel, SVRModel, kernel_map


def score_stream(model: Model, stream: DataFrame, path: str, progress: str, columns: list[str] | None = None):
    """Score everything that has arrived and append it to Parquet files at ``path``.

    Row-wise models keep no state between batches, so there is no watermark; ``progress`` is
    the checkpoint folder that makes restarts exact.
    """
    scored = model.transform(stream)
    if columns:
        scored = scored.select(*columns)
    query = (
        scored.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def register(spark: SparkSession, model, name: str) -> None:
    """Make ``name(features ARRAY<DOUBLE>)`` callable from SQL.

    A linear model becomes a SQL function, which Catalyst inlines as a plain expression; the
    others become Arrow-batched functions. Linear and kernel classifiers with numeric classes give
    the class as a double.
    """
    if not name.isidentifier():
        raise ValueError(f"not a function name: {name!r}")
    if isinstance(model, LinearModel):
        weights = ", ".join(f"{float(w)!r}D" for w in model.state["coef"])
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
            f"aggregate(zip_with(x, array({weights}), (a, w) -> a * w), {float(model.state['intercept'])!r}D, (s, v) -> s + v)"
        )
        return
    apply, scalar = _block_function(model)

    if scalar:

        @arrow_udf("double")
        def run(batch: pa.Array) -> pa.Array:
            return pa.array(np.asarray(apply(to_matrix(batch)), dtype=np.float64))

    else:

        @arrow_udf("array<double>")
        def run(batch: pa.Array) -> pa.Array:
            return to_lists(np.asarray(apply(to_matrix(batch)), dtype=np.float64))

    spark.udf.register(name, run)


def _block_function(model) -> tuple[Callable, bool]:
    if isinstance(model, _ScalerModel):
        centre, unit, low = model._factors()
        return lambda x: (x - centre) / unit + low, False
    if isinstance(model, _ProjectionModel):
        parts, mean = model.state["components"], model.state["mean"]
        return lambda x: (x - mean) @ parts.T, False
    if isinstance(model, KMeansModel):
        centres = model.state["centres"]
        return lambda x: centre_distances(x, centres).argmin(axis=1), True
    if isinstance(model, ScoredClasses):
        coef, shift, classes = np.atleast_2d(model.state["coef"]), model.state["intercept"], np.array(model.state["classes"], dtype=np.float64)

        def label(x):
            values = x @ coef.T + shift
            return classes[(values[:, 0] > 0).astype(int) if len(coef) == 1 else values.argmax(axis=1)]

        return label, True
    if isinstance(model, SVCModel):
        lift, coef, shift, classes = kernel_map(model.state), model.state["coef"], model.state["intercept"], np.array(model.state["classes"], dtype=np.float64)

        def label(x):
            values = lift(x) @ coef.T + shift
            return classes[(values[:, 0] > 0).astype(int) if len(coef) == 1 else values.argmax(axis=1)]

        return label, True
    if isinstance(model, SVRModel):
        lift, coef, shift = kernel_map(model.state), model.state["coef"][0], model.state["intercept"][0]
        return lambda x: lift(x) @ coef + shift, True
    raise TypeError(f"{type(model).__name__} cannot be registered as a SQL function")
