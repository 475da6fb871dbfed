"""Scalers and the label encoder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Fitted, Learner
from ..functions.vectors import constant_array, feature_array, is_scalar, scalar_columns
from ..plans.gram import column_moments
from ..plans.order import dense_index



def rescale(df: DataFrame, spec, scale, offset, invalid: str = "error") -> Column:
    """``x * scale + offset`` per feature as ARRAY<DOUBLE>."""
    x = feature_array(df, spec, invalid)
    if is_scalar(df, spec):
        cols = scalar_columns(spec)
        out = F.array(*[c * F.lit(float(a)) + F.lit(float(b)) for c, a, b in zip(cols, scale, offset)])
        return F.when(x.isNotNull(), out)
    scaled = F.zip_with(x, constant_array(scale), lambda v, a: v * a)
    return F.zip_with(scaled, constant_array(offset), lambda v, b: v + b)


class _ScalerModel(Fitted):
    HYPER = {"output_col": "scaled", "restored_col": "restored"}
    VERBS = frozenset({"fit", "transform", "fit_transform", "inverse_transform"})

    def _factors(self) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        df = self._input(df)
        centre, unit, low = self._factors()
        spec, invalid = self.setting("features_col"), self.setting("handle_invalid")
        x = feature_array(df, spec, invalid)
        if is_scalar(df, spec):
            parts = [(c - F.lit(float(m))) / F.lit(float(s)) + F.lit(float(b))
                     for c, m, s, b in zip(scalar_columns(spec), centre, unit, low)]
            out = F.when(x.isNotNull(), F.array(*parts))
        else:
            moved = F.zip_with(x, constant_array(centre), lambda v, m: v - m)
            out = F.zip_with(moved, constant_array(unit), lambda v, s: v / s)
            if np.any(low):
                out = F.zip_with(out, constant_array(low), lambda v, b: v + b)
        return df.withColumn(self.setting("output_col"), out)

    def _inverse(self, df: DataFrame) -> DataFrame:
        centre, unit, low = self._factors()
        restored = rescale(df, self.setting("output_col"), unit, centre - low * unit, "keep")
        return df.withColumn(self.setting("restored_col"), restored)


class StandardScalerModel(_ScalerModel):
    HYPER = {"with_mean": True, "with_std": True}

    def _factors(self):
        mean = self.state["mean"] if self.setting("with_mean") else np.zeros_like(self.state["mean"])
        std = self.state["std"] if self.setting("with_std") else np.ones_like(mean)
        return mean, np.where(std == 0, 1.0, std), np.zeros_like(mean)


class StandardScaler(Learner):
    """``(x - mean) / population std`` per feature; a constant feature becomes 0."""

    HYPER = {**_ScalerModel.HYPER, **StandardScalerModel.HYPER}
    VERBS = _ScalerModel.VERBS

    def _train(self, df: DataFrame) -> Fitted:
        stats = column_moments(df, self.setting("features_col"), "mean", "std")
        # a constant column may show a std of rounding size; treat it as zero
        noise = np.abs(stats["mean"]) * np.sqrt(stats["count"]) * 1e-15
        stats["std"] = np.where(stats["std"] <= noise, 0.0, stats["std"])
        return StandardScalerModel(stats)


class MinMaxScalerModel(_ScalerModel):
    HYPER = {"feature_range": [0.0, 1.0]}

    def _factors(self):
        low, high = self.setting("feature_range")
        span = self.state["max"] - self.state["min"]
        unit = np.where(span == 0, 1.0, span) / (high - low)
        return self.state["min"], unit, np.full_like(span, low)


class MinMaxScaler(Learner):
    """Each feature mapped to ``feature_range``; new rows may leave it."""

    HYPER = {**_ScalerModel.HYPER, **MinMaxScalerModel.HYPER}
    VERBS = _ScalerModel.VERBS

    def _train(self, df: DataFrame) -> Fitted:
        return MinMaxScalerModel(column_moments(df, self.setting("features_col"), "min", "max"))


class LabelEncoderModel(Fitted):
    HYPER = {"output_col": "code", "restored_col": "restored"}
    VERBS = frozenset({"fit", "transform", "fit_transform", "inverse_transform"})

    def _lookup(self, df: DataFrame, key: str, found: str, out: str) -> DataFrame:
        classes = self.tables["classes"].select(
            F.col("label" if found == "code" else "code").alias("_key"), F.col(found).alias("_found"), "n"
        )
        # one row per class: Spark broadcasts them by their size, or splits the hot keys of the data at hand
        left = df.withColumn("_key", F.col(key))
        if self.setting("handle_invalid") == "skip":
            left = left.where(F.col("_key").isNotNull())
        joined = left.join(classes.drop("n"), "_key", "left")
        unseen = F.raise_error(F.concat(F.lit("value was not seen in fit: "), F.coalesce(F.col("_key").cast("string"), F.lit("null; handle_invalid='skip' drops such rows"))))
        value = F.when(F.col("_found").isNull(), unseen).otherwise(F.col("_found"))
        return joined.withColumn(out, value).select(*[c for c in df.columns if c != out], out)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._lookup(df, self.setting("label_col"), "code", self.setting("output_col"))

    def _inverse(self, df: DataFrame) -> DataFrame:
        return self._lookup(df, self.setting("output_col"), "label", self.setting("restored_col"))

    @property
    def classes(self) -> DataFrame:
        return self.tables["classes"].select("code", "label")


class LabelEncoder(Learner):
    """Sorted distinct labels (numbers by value, text by code point) to 0..K-1 and back."""

    HYPER = LabelEncoderModel.HYPER
    VERBS = LabelEncoderModel.VERBS

    def _rows(self, df: DataFrame, supervised: bool) -> DataFrame:
        label = self.setting("label_col")
        if label not in df.columns:
            raise ValueError(f"label column {label!r} not found; have {df.columns}")
        return df.where(F.col(label).isNotNull()) if self.setting("handle_invalid") == "skip" else df

    def _train(self, df: DataFrame) -> Fitted:
        counted = df.groupBy(F.col(self.setting("label_col")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        classes = dense_index(counted.where(F.col("label").isNotNull()), "label", "code")
        return LabelEncoderModel({"n_classes": classes.count()}, {"classes": classes})
