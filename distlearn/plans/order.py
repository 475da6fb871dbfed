"""Dense numbering of distinct values without a global single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

SMALL = 100_000  # up to this many values, one task numbers them


def dense_index(values: DataFrame, column: str, index: str, small: int = SMALL) -> DataFrame:
    """Add ``index`` = 0..K-1 in the order of the (distinct) ``column``."""
    values = settle(values, "values")
    if values.limit(small + 1).count() <= small:
        position = F.row_number().over(Window.orderBy(column)).cast("long") - 1
        return values.withColumn(index, position)
    ranged = settle(
        values.repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    sizes = sorted(ranged.groupBy("_part").count().collect())  # one row per partition
    starts, seen = [], 0
    for part, n in sizes:
        starts.append((part, seen))
        seen += n
    offsets = values.sparkSession.createDataFrame(starts, "_part int, _start long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column)).cast("long") - 1
    return (
        ranged.withColumn(index, inside)
        .join(F.broadcast(offsets), "_part")
        .withColumn(index, F.col(index) + F.col("_start"))
        .drop("_part", "_start")
    )


def running_totals(df: DataFrame, column: str, sums: list[str]) -> DataFrame:
    """Add ``total_<c>``: the sum of c over all rows up to this one in the order of ``column``.

    Rows are range-partitioned; only one row of partial sums per partition reaches the driver.
    """
    ranged = settle(df.repartitionByRange(F.col(column)).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = sorted(ranged.groupBy("_part").agg(*[F.sum(c) for c in sums]).collect())
    starts, seen = [], [0] * len(sums)
    for row in parts:
        starts.append((row[0], *seen))
        seen = [s + (v or 0) for s, v in zip(seen, row[1:])]
    kinds = ", ".join(f"_s_{c} {ranged.schema[c].dataType.simpleString()}" for c in sums)
    offsets = df.sparkSession.createDataFrame(starts, f"_part int, {kinds}")
    inside = Window.partitionBy("_part").orderBy(column)
    out = ranged.join(F.broadcast(offsets), "_part")
    for c in sums:
        out = out.withColumn(f"total_{c}", F.sum(c).over(inside) + F.col(f"_s_{c}"))
    return out.drop("_part", *[f"_s_{c}" for c in sums])
