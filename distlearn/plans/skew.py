"""Joins and groupings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 200_000  # rows of one key that a single task should handle
LISTED_KEYS = 100_000  # so many hot keys may be broadcast; more are joined


def hot_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    weight: str,
    spread: Column,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    total: int | None = None,
) -> DataFrame:
    """Join where ``right`` has one row per key and ``weight`` = number of left rows with it.

    Keys above ``hot_rows`` rows, however large the table, are salted: the left rows by ``spread``
    (a hash of the row id), the single right row copied once per salt. There are at most
    total / hot_rows hot keys; their list is counted, broadcast up to LISTED_KEYS and joined
    beyond. ``total`` = sum of the weights, if the caller knows it.
    """
    if total is None:
        total = right.agg(F.sum(weight)).head()[0] or 0
    if total <= hot_rows:
        return left.join(right.drop(weight), on, how)
    pieces = F.ceil(F.col(weight) / F.lit(hot_rows)).cast("int")
    hot = right.where(F.col(weight) > hot_rows).select(on, pieces.alias("_salts"))
    listed = total // hot_rows <= LISTED_KEYS or hot.count() <= LISTED_KEYS
    salted = left.join(F.broadcast(hot) if listed else hot, on, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(spread, F.col("_salts")).cast("int"))
    )
    last = F.when(F.col(weight) > hot_rows, pieces - 1).otherwise(F.lit(0))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop(weight)
    return salted.join(copies, [on, "_salt"], how).drop("_salt", "_salts")
