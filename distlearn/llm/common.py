"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle as write_table

WORD = r"[^\x20\x09-\x0D]+"  # a word: no space, tab, line or page break
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",  # a step's shuffles go when it is written
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",  # texts are long: small batches to and from Python
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, read it back, and free the shuffles it took.

    The table has no lineage, so a lost executor costs no earlier stage, and the disk holds one
    step's shuffle files at a time instead of all of them.
    """
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        conf.set(k, v)
    try:
        return write_table(df, name)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def whole_text(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; maps, which have no hash of their own, count as JSON, and where nulls stand counts too."""
    columns = [(F.col(f"`{f.name}`"), "map<" in f.dataType.simpleString()) for f in df.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c)) if mapped else c for c, mapped in columns], *[c.isNull() for c, _ in columns])


def fold(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids have the remainder 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus, F.lit(0))


def crc_fold(doc_id: int | None, modulus: int) -> int:
    """The same remainder in Python."""
    import zlib

    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def each_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per key of a stream that is sorted by ``keys``; only the key at hand is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
            new[0] |= bool(held) and held[-1].column(k)[held[-1].num_rows - 1].as_py() != v[0]
        start = 0
        for at in (*np.flatnonzero(new), batch.num_rows):
            if at > start:
                held.append(batch.slice(start, at - start))
            if at < batch.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            start = at
    if held:
        yield pa.Table.from_batches(held)


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes, those of one significance side by side."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 3)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def paired_pieces(rows: DataFrame, keys: list[str], spread: Column, limit: int) -> DataFrame:
    """Rows of each key, so dealt out that every two rows of a key meet in exactly one task.

    Keys of up to ``limit`` rows stay whole (piece and other are 0). Larger ones are cut into pieces by
    ``spread``, a hash of the row; each piece meets each piece, itself included, in a task of its own, so a
    hot key is spread over many tasks. Sorted by the keys, piece and other; ``own`` is the row's piece.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    hot = settle(sizes.withColumn("_pieces", F.ceil(F.col("_n") / limit).cast("int")).drop("_n"), "hot")
    own = F.pmod(spread, F.coalesce("_pieces", F.lit(1))).cast("int")
    met = rows.join(hot, keys, "left").withColumn("own", own).withColumn(
        "_with", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
    )
    dealt = met.withColumn("piece", F.least("own", "_with")).withColumn("other", F.greatest("own", "_with")).drop("_with", "_pieces")
    by = [*keys, "piece", "other"]
    return dealt.repartition(*map(F.col, by)).sortWithinPartitions(*by)


def usable_vector(name: str) -> Column:
    """True for vectors without null or non-finite components that aren't zero."""
    v = F.col(name)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists of numbers as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, summed in the order of components."""
    dot, left, right = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        left += a[:, k] * a[:, k]
        right += b[:, k] * b[:, k]
    return np.clip(dot / np.sqrt(left * right), -1, 1)
