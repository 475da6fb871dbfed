"""Distance joins without an all-pairs plan.

Rows are assigned to the cell of their nearest pivot. Pivots are drawn from the data, so a
dense region gets many cells. For a query row, the triangle inequality and the bisecting
plane between two pivots tell which cells can hold a row within a given radius; the row is
sent to those cells only. Inside a cell, rows travel as bounded blocks and queries as
bounded chunks; an ordinary equi-join on (cell, slices) brings them together and a numpy
kernel reduces each pair of blocks at once, so no pair of rows is ever emitted.

Only the pivots and the per-cell counts (at most MAX_PIVOTS entries) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import squared_distances
from ..functions.vectors import to_matrix

MAX_PIVOTS = 4096
CELL_ROWS = 2048  # wanted rows per cell while there are fewer than MAX_PIVOTS cells
BLOCK_ROWS = 2048  # rows of a cell handled together
CHUNK_ROWS = 512  # queries handled together
SLICE_ROWS = 131_072  # a cell with more rows is split over several tasks
QUERY_SLICE_ROWS = 16_384  # and so is a cell with more queries
ROUTE_ROWS = 1024  # queries compared with all pivots at once
DRAWN_VALUES = 4_000_000  # numbers in a drawn set of rows: 32 MB travel with a task at most
COPIES = 1000  # equal rows that need no special care
LARGE = np.iinfo(np.int64).max


class Cells:
    """Pivots and what is known about each cell: ``radius``, ``rows`` and ``weight``."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.centre = pivots.mean(axis=0)
        self.radius = np.zeros(len(pivots))
        self.rows = np.zeros(len(pivots), dtype=np.int64)
        self.weight = np.zeros(len(pivots), dtype=np.int64)

    def __len__(self) -> int:
        return len(self.pivots)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(squared_distances(x - self.centre, self.pivots - self.centre))

    def slack(self, x: np.ndarray) -> float:
        """Rounding error that a distance to a pivot can carry."""
        return 1e-7 * (np.abs(x - self.centre).max(initial=0) + np.abs(self.pivots - self.centre).max()) * np.sqrt(
            x.shape[1]
        )

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distance from each row of x to any row of each cell."""
        to = self.distances(x)
        home = to.argmin(axis=1)
        apart = self.distances(self.pivots[home])
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (to**2 - (to[np.arange(len(x)), home] ** 2)[:, None]) / (2.0 * apart)
        plane = np.where(apart > 0, plane, 0.0)
        slack = self.slack(x)
        low = np.maximum(np.maximum(to - self.radius, plane) - slack, 0.0)
        low[:, self.rows == 0] = np.inf
        return low, to + self.radius + slack


def pivot_count(rows: int, cell_rows: int) -> int:
    return max(1, min(MAX_PIVOTS, -(-rows // cell_rows)))


def draw_rows(points: DataFrame, count: int, rows: int, seed: int = 0, exact: bool = False) -> np.ndarray:
    """Up to ``count`` distinct rows of column x, chosen by hash, so copies are drawn once.

    A hash filter keeps about 16 times the wanted number before the grouping, so a large
    table is read but not shuffled. If copies leave too few, all rows are grouped. More than
    DRAWN_VALUES numbers never reach the driver: with ``exact`` that is an error, else fewer rows
    are drawn (pivots may be fewer, results stay the same).
    """
    d = max(1, (points.select(F.size("x")).head() or [1])[0])
    if count * d > DRAWN_VALUES:
        if exact:
            raise ValueError(f"{count} rows of {d} features are more than {DRAWN_VALUES} numbers; ask for fewer")
        count = max(1, DRAWN_VALUES // d)
    drawn = points.select("x", F.xxhash64("x", F.lit(seed)).alias("h"))
    share = 16.0 * count / max(rows, 1)
    thin = drawn.where(F.pmod("h", F.lit(1 << 32)) < int(share * (1 << 32))) if share < 0.5 else drawn
    for source in (thin, drawn):
        picked = source.groupBy("h").agg(F.first("x").alias("x")).orderBy("h").limit(count).collect()
        if 2 * len(picked) > count or source is drawn:
            break
    return np.array([r["x"] for r in picked], dtype=np.float64)


def heaviest_copy(rows: DataFrame) -> int:
    """The size of the largest group of equal x; only 8-byte hashes are shuffled."""
    groups = rows.groupBy(F.xxhash64("x").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.max("n")).head()[0] or 0


def assign(points: DataFrame, cells: Cells) -> DataFrame:
    """Columns id, x (and more) -> the same with ``cell`` and the exact ``dist`` to its pivot."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = to_matrix(batch.column("x"), cells.pivots.shape[1])
            cell = np.empty(len(x), dtype=np.int32)
            for i in range(0, len(x), ROUTE_ROWS):
                cell[i : i + ROUTE_ROWS] = cells.distances(x[i : i + ROUTE_ROWS]).argmin(axis=1)
            dist = np.sqrt(((x - cells.pivots[cell]) ** 2).sum(axis=1))
            names = batch.schema.names + ["cell", "dist"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(nearest, f"{fields}, cell int, dist double")


def measure(assigned: DataFrame, cells: Cells, weight: str | None = None) -> int | None:
    """Fill in the cells' radius, rows and weight from an assigned (and settled) table.

    Returns the smallest id, or None for an empty table.
    """
    heavy = F.sum(weight) if weight else F.count(F.lit(1))
    found = assigned.groupBy("cell").agg(F.max("dist"), F.count(F.lit(1)), heavy, F.min("id"))
    least = None
    for cell, radius, rows, total, first in found.collect():  # at most one row per pivot
        cells.radius[cell], cells.rows[cell], cells.weight[cell] = radius, rows, total
        least = first if least is None else min(least, first)
    return least


def slices(counts: np.ndarray, rows: int) -> np.ndarray:
    return np.maximum(1, -(-counts // rows))


def pack(rows: DataFrame, mine: np.ndarray, others: np.ndarray, size: int, side: str, keys: list[str]) -> DataFrame:
    """Rows (cell, dist, id, x, more) -> blocks of at most ``size`` rows, one list per column.

    A cell's rows are spread over ``mine[cell]`` slices by a hash of the id; each block is
    copied once for each of the ``others[cell]`` slices of the other side. With both sides
    sliced, every join key holds a bounded amount of work even if one cell is hot.
    """
    extra = [c for c in rows.columns if c not in ("cell", "dist", "id", "x")]
    many = bool((mine > 1).any())
    own = F.pmod(F.xxhash64("id"), _pick(mine)).cast("int") if many else F.lit(0)
    spread = rows.withColumn("own", own)
    spread = spread.repartition(tasks(rows), "cell", "own") if len(mine) > 1 or many else spread.coalesce(1)
    spread = spread.sortWithinPartitions("cell", "own", "dist", "id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cell, part, dist = (batch.column(c).to_numpy() for c in ("cell", "own", "dist"))
            fresh = np.ones(n, dtype=bool)
            fresh[1:] = (np.diff(cell) != 0) | (np.diff(part) != 0)
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(fresh, at, 0))
            starts = np.flatnonzero(fresh | ((at - begin) % size == 0))
            offsets = np.append(starts, n).astype(np.int32)
            x = to_matrix(batch.column("x"))
            out = [pa.array(cell[starts]), pa.array(part[starts]), pa.array(np.minimum.reduceat(dist, starts)),
                   pa.array(np.maximum.reduceat(dist, starts))]
            for name in ("id", "dist", *extra):
                out.append(pa.ListArray.from_arrays(pa.array(offsets), batch.column(name)))
            wide = pa.array(offsets.astype(np.int64) * x.shape[1])
            out.append(pa.LargeListArray.from_arrays(wide, pa.array(x.ravel())).cast(pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["cell", "own", "low", "high", "ids", "dists", *extra, "xs"]
    kinds = ", ".join(f"`{c}` array<{rows.schema[c].dataType.simpleString()}>" for c in extra)
    schema = f"cell int, own int, low double, high double, ids array<long>, dists array<double>, {kinds + ', ' if kinds else ''}xs array<double>"
    packed = spread.mapInArrow(blocks, schema)
    if (others > 1).any():
        packed = packed.withColumn("other", F.explode(F.sequence(F.lit(0), _pick(others) - 1)))
    else:
        packed = packed.withColumn("other", F.lit(0))
    b, q = ("own", "other") if side == "block" else ("other", "own")
    tag = "b_" if side == "block" else "q_"
    named = packed.select(
        "cell", F.col(b).alias("b_slice"), F.col(q).alias("q_slice"),
        *[F.col(c).alias(tag + c) for c in packed.columns if c not in ("cell", "own", "other")],
    )
    # the exchange that the join needs, with a fixed task count: few bytes here can mean much work
    return named.repartition(tasks(rows), *keys)


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pick(counts: np.ndarray):
    return F.element_at(F.expr(f"array({','.join(str(int(v)) for v in counts)})"), F.col("cell") + 1)


def meet(queries: DataFrame, points: DataFrame, n_queries: np.ndarray, n_points: np.ndarray,
         kernel: Callable, schema: str) -> DataFrame:
    """Join routed queries with the points of their cells and reduce block by block.

    ``kernel(rows)`` is a generator over joined records (dicts of numpy arrays).
    """
    qs, bs = slices(n_queries, QUERY_SLICE_ROWS), slices(n_points, SLICE_ROWS)
    # a slice number that is always 0 is no join key: as a constant it would cost an exchange
    keys = ["cell"] + ["b_slice"] * bool((bs > 1).any()) + ["q_slice"] * bool((qs > 1).any())
    chunks = pack(queries, qs, bs, CHUNK_ROWS, "chunk", keys)
    blocks = pack(points, bs, qs, BLOCK_ROWS, "block", keys)
    joined = chunks.join(blocks.drop(*{"b_slice", "q_slice"}.difference(keys)), keys)
    return joined.mapInArrow(lambda batches: kernel(_records(batches)), schema)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {
                name: col[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(col.type) else col[i].as_py()
                for name, col in zip(batch.schema.names, batch.columns)
            }


def block_of(record: dict, side: str) -> np.ndarray:
    n = len(record[f"{side}_ids"])
    return record[f"{side}_xs"].reshape(n, -1)


def within(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Exact ``distance <= radius`` for two blocks; close calls are decided by direct difference."""
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    squared = squared_distances(a, b)
    gap = squared - radius * radius
    size = (a**2).sum(axis=1).max() + (b**2).sum(axis=1).max()
    mask = gap <= 0
    rows, cols = np.nonzero(np.abs(gap) <= 1e-12 * max(size, radius * radius))
    for i in range(0, len(rows), 65_536):
        r, c = rows[i : i + 65_536], cols[i : i + 65_536]
        mask[r, c] = np.sqrt(((a[r] - b[c]) ** 2).sum(axis=1)) <= radius
    return mask


def routed_batches(x: np.ndarray, mask: np.ndarray, columns: dict, step: int = 8192) -> Iterator[pa.RecordBatch]:
    """One output row for each True in mask (query x cell), in bounded batches."""
    rows, cell = np.nonzero(mask)
    for i in range(0, len(rows), step):
        r, c = rows[i : i + step], cell[i : i + step]
        offsets = pa.array(np.arange(len(r) + 1, dtype=np.int32) * x.shape[1])
        xs = pa.ListArray.from_arrays(offsets, pa.array(x[r].ravel()))
        arrays = [pa.array(c.astype(np.int32)), *[pa.array(v[r, c] if v.ndim == 2 else v[r]) for v in columns.values()], xs]
        yield pa.RecordBatch.from_arrays(arrays, ["cell", *columns, "x"])


def cell_counts(routed: DataFrame, size: int) -> np.ndarray:
    counts = np.zeros(size, dtype=np.int64)
    for cell, n in routed.groupBy("cell").count().collect():  # at most one row per pivot
        counts[cell] = n
    return counts
