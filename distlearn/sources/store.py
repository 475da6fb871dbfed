"""Named models in a folder that the cluster can read: save, load, list."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class ModelStore:
    """Each model is a folder with JSON metadata and, if it has tables, Parquet data."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if not NAME.fullmatch(name):
            raise ValueError(f"model name {name!r} may hold only letters, digits, '.', '_' and '-'")
        return f"{self.root}/{name}"

    def save(self, model, name: str) -> str:
        """Save under ``name``, replacing an older model; returns the path."""
        path = self.path(name)
        model.write().overwrite().save(path)
        return path

    def load(self, name: str):
        """The model (or chain, or unfitted operator) saved under ``name``."""
        path = self.path(name)
        try:
            return DefaultParamsReader.loadParamsInstance(path, self.spark)
        except AnalysisException as missing:
            raise FileNotFoundError(f"no model named {name!r} in {self.root}") from missing

    def list_saved(self) -> DataFrame:
        """(name, class, params, saved_at), sorted by name."""
        try:
            lines = self.spark.read.text(f"{self.root}/*/metadata").select("value", "_metadata.file_path")
        except AnalysisException:
            return self.spark.createDataFrame([], "name string, class string, params string, saved_at timestamp")
        name = F.regexp_extract("file_path", r"([^/]+)/metadata/[^/]+$", 1)
        get = lambda key: F.get_json_object("value", f"$.{key}")
        return lines.select(
            name.alias("name"),
            F.element_at(F.split(get("class"), r"\."), -1).alias("class"),
            get("paramMap").alias("params"),
            F.timestamp_millis(get("timestamp").cast("long")).alias("saved_at"),
        ).orderBy("name")
