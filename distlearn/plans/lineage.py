"""Cutting lineage in iterative jobs by writing tables to the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors share."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    return named.rstrip("/")


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, survives lost executors and carries file sizes, so the
    optimizer can judge later joins. The shuffle files of the write go when it has ended; otherwise
    they would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/distlearn/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete tables written by :func:`settle` that later steps no longer read."""
    for table in tables:
        path = getattr(table, "_settled_path", None)
        if path:
            jvm = table.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            conf = table.sparkSession._jsparkSession.sessionState().newHadoopConf()
            target.getFileSystem(conf).delete(target, True)
