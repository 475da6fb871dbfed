"""Random draws that depend only on (row id, seed, stream), never on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1 << 52


def bucket(key: Column, seed: int, buckets: int, stream=0) -> Column:
    """A uniform whole number in [0, buckets)."""
    stream = stream if isinstance(stream, Column) else F.lit(stream)
    return F.pmod(F.xxhash64(key, F.lit(int(seed)), stream.cast("long")), F.lit(buckets))


def uniform(key: Column, seed: int, stream=0) -> Column:
    """A uniform number strictly between 0 and 1."""
    return (bucket(key, seed, BUCKETS, stream) + F.lit(0.5)) / F.lit(float(BUCKETS))


def normal(key: Column, seed: int, stream: int = 0) -> Column:
    """A standard normal number (Box-Muller on two uniform draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(key, seed, 2 * stream)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(key, seed, 2 * stream + 1))
