"""Common ground of all operators: settings, verbs, model state and persistence.

Every operator is a ``pyspark.ml`` Estimator and every fitted result a ``pyspark.ml``
Model, so they chain in ``pyspark.ml.Pipeline`` and are tuned by ``CrossValidator``.
On top of that each class offers the short verbs fit / predict / transform /
fit_transform / fit_predict / inverse_transform / score.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.vectors import check_features, drop_invalid, feature_array


class UnsupportedVerb(TypeError):
    """The operator does not offer this verb; raised before any job starts."""


class Configured(Params):
    """Keyword settings kept as Spark ML ``Param`` objects."""

    HYPER: dict = {
        "features_col": "features",
        "label_col": "label",
        "id_col": "id",
        "prediction_col": "prediction",
        "output_col": "output",
        "handle_invalid": "error",
    }
    VERBS: frozenset = frozenset()

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        for name in cls.HYPER:
            if not isinstance(getattr(cls, name, None), Param):
                setattr(cls, name, Param(Params._dummy(), name, f"{cls.__name__} setting {name}"))

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(**self.defaults())
        self._assign(settings)

    @classmethod
    def defaults(cls) -> dict:
        merged: dict = {}
        for base in reversed(cls.__mro__):
            merged.update(base.__dict__.get("HYPER", {}))
        return merged

    def _assign(self, settings: dict) -> None:
        known = self.defaults()
        for name, value in settings.items():
            if name not in known:
                raise TypeError(f"{type(self).__name__} has no setting {name!r}; it has {sorted(known)}")
            if isinstance(value, tuple | range):
                value = list(value)
            if isinstance(value, np.ndarray | np.generic):
                value = value.tolist()
            self._set(**{name: value})

    def setting(self, name: str):
        return self.getOrDefault(getattr(self, name))

    def get_params(self) -> dict:
        """All settings with their current values."""
        return {name: self.setting(name) for name in self.defaults()}

    def __repr__(self) -> str:
        given = {p.name: v for p, v in self._paramMap.items()}
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in sorted(given.items()))})"

    def _give(self, to):
        """Hand the settings that ``to`` also has on to it."""
        shared = {p.name for p in to.params}
        for p, v in self.extractParamMap().items():
            if p.name in shared:
                to._set(**{p.name: v})
        return to

    def _need(self, verb: str) -> None:
        if verb not in self.VERBS:
            raise UnsupportedVerb(f"{type(self).__name__} does not support {verb}()")

    def _x(self, df: DataFrame) -> Column:
        return feature_array(df, self.setting("features_col"), self.setting("handle_invalid"))

    def _rows(self, df: DataFrame, supervised: bool) -> DataFrame:
        """Training rows after the null policy."""
        check_features(df, self.setting("features_col"))
        label = self.setting("label_col") if supervised else None
        if label and label not in df.columns:
            raise ValueError(f"label column {label!r} not found; have {df.columns}")
        if self.setting("handle_invalid") == "skip":
            return drop_invalid(df, self.setting("features_col"), label)
        if label:
            missing = F.raise_error(F.lit(f"null in label {label!r}; drop those rows or use handle_invalid='skip'"))
            return df.withColumn(label, F.when(F.col(label).isNull(), missing).otherwise(F.col(label)))
        return df


class _ModelWriter(MLWriter):
    def __init__(self, instance: Fitted):
        super().__init__()
        self.instance = instance

    def save(self, path: str) -> None:
        if self.instance.tables and getattr(self.instance, "_home", None) == path.rstrip("/"):
            raise ValueError(f"this model reads its tables from {path}; save it under another name")
        super().save(path)

    def saveImpl(self, path: str) -> None:
        m = self.instance
        extra = {
            "state": {k: _encode(v) for k, v in m.state.items()},
            "tables": sorted(m.tables),
            "native": sorted(m.native),
        }
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata=extra)
        for name, table in m.tables.items():
            table.write.parquet(f"{path}/tables/{name}")
        for name, stage in m.native.items():
            stage.write().save(f"{path}/native/{name}")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {n: self.sparkSession.read.parquet(f"{path}/tables/{n}") for n in meta["tables"]}
        native = {
            n: DefaultParamsReader.loadParamsInstance(f"{path}/native/{n}", self.sparkSession)
            for n in meta["native"]
        }
        model = self.cls({k: _decode(v) for k, v in meta["state"].items()}, tables, native)
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model._home = path.rstrip("/")
        return model


def _encode(value):
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "shape": list(value.shape), "dtype": str(value.dtype)}
    return json.loads(json.dumps(value, default=lambda v: v.item()))


def _decode(value):
    if isinstance(value, dict) and "dtype" in value:
        return np.array(value["array"], dtype=value["dtype"]).reshape(value["shape"])
    return value


class Fitted(Configured, Model, MLWritable, MLReadable):
    """A fitted, immutable model: small arrays, tables on the cluster, Spark ML models."""

    def __init__(self, state: dict | None = None, tables: dict | None = None, native: dict | None = None):
        super().__init__()
        # row-major, as arrays come back from a file: the same bits before and after a reload
        self.state = {k: np.ascontiguousarray(v) if isinstance(v, np.ndarray) else v for k, v in (state or {}).items()}
        self.tables = tables or {}
        self.native = native or {}

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)

    def save(self, path: str) -> str:
        """Save, replacing an older model of this name; returns the path."""
        self.write().overwrite().save(path)
        return path

    def _input(self, df: DataFrame) -> DataFrame:
        check_features(df, self.setting("features_col"))
        if self.setting("handle_invalid") == "skip":
            return drop_invalid(df, self.setting("features_col"))
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        self._need("predict")
        return self._predict(self._input(df))

    def _predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.predict(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._need("inverse_transform")
        return self._inverse(df)

    def _inverse(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def score(self, df: DataFrame) -> float:
        """Accuracy for classifiers, R-squared for regressors: one aggregate."""
        self._need("score")
        return self._score(self.predict(df))

    def _score(self, predicted: DataFrame) -> float:
        y, p = F.col(self.setting("label_col")), F.col(self.setting("prediction_col"))
        if self.KIND == "classifier":
            return predicted.agg(F.avg((y == p).cast("double"))).head()[0]
        return r_squared(predicted, y, p)

    KIND = "regressor"


class Learner(Configured, Estimator, MLWritable, MLReadable):
    """An operator that can be fitted. Verbs other than fit use the last fitted model."""

    MODEL: type[Fitted] = Fitted
    SUPERVISED = False

    def __init__(self, **settings):
        super().__init__(**settings)
        self.model_ = None

    def set_params(self, **settings):
        """Change settings; a model fitted before is dropped."""
        self._assign(settings)
        self.model_ = None
        return self

    def copy(self, extra=None):
        that = super().copy(extra)
        that.model_ = None
        return that

    def fit(self, df: DataFrame, params=None):
        self._need("fit")
        fitted = super().fit(df, params)
        if isinstance(fitted, Model):
            self.model_ = fitted
        return fitted

    def _fit(self, df: DataFrame) -> Fitted:
        return self._give(self._train(self._rows(df, self.SUPERVISED)))

    def _train(self, df: DataFrame) -> Fitted:
        raise NotImplementedError

    def _last(self, verb: str) -> Fitted:
        self._need(verb)
        if self.model_ is None:
            raise ValueError(f"call fit() before {verb}()")
        return self.model_

    def predict(self, df: DataFrame) -> DataFrame:
        return self._last("predict").predict(df)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._last("transform").transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._last("inverse_transform").inverse_transform(df)

    def score(self, df: DataFrame) -> float:
        return self._last("score").score(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self._need("fit_transform")
        return self.fit(df).transform(df)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        self._need("fit_predict")
        return self.fit(df).predict(df)

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)

    def save(self, path: str) -> str:
        """Save the fitted model (replacing an older one of this name); returns the path."""
        if self.model_ is None:
            self.write().overwrite().save(path)
            return path
        return self.model_.save(path)


def r_squared(df: DataFrame, y: Column, p: Column) -> float:
    """1 - SSE/SST in one pass; var_pop keeps the sum of squares accurate."""
    row = df.agg(F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("var")).head()
    if row["var"] == 0:
        return 1.0 if row["mse"] == 0 else 0.0
    return 1.0 - row["mse"] / row["var"]


def class_counts(df: DataFrame, label: str) -> dict:
    """Sorted labels with their row counts: one row per class, as the fitted model itself has."""
    rows = df.groupBy(label).count().collect()
    if any(r[0] is None for r in rows):
        raise ValueError(f"null in label {label!r}; drop those rows or use handle_invalid='skip'")
    if len(rows) < 2:
        raise ValueError(f"need at least two classes in {label!r}, found {[r[0] for r in rows]}")
    return dict(sorted((r[0], r[1]) for r in rows))


def class_list(df: DataFrame, label: str) -> list:
    return list(class_counts(df, label))


def label_array(classes: list) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def label_index(label: str, classes: list) -> Column:
    """0..K-1 as DOUBLE, the label form Spark's classifiers take."""
    return (F.array_position(label_array(classes), F.col(label)) - 1).cast("double")


def class_metadata(classes: list) -> dict:
    """Tells Spark's classifiers the number of classes; without it they take 100 at most."""
    return {"ml_attr": {"type": "nominal", "num_vals": len(classes)}}


def label_value(index: Column, classes: list) -> Column:
    return F.element_at(label_array(classes), (index + 1).cast("int"))

