"""Input of iterative fits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def over_all_cores(df: DataFrame) -> DataFrame:
    """Spread rows that come in fewer partitions than there are cores.

    A fit that passes over its rows many times would otherwise keep most cores idle. Large
    inputs have more partitions than that and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
