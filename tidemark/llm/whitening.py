"""Embedding whitening (operator 12) with distributed block matrices.

Vectors become whole numbers, so sums, means and deviations are exact.  Centred rows are
indexed and laid into tiles of equal height, the blocks of an MLlib ``BlockMatrix``:

- The tiles of the distinct vectors, one below the other, times themselves transposed give the
  scatter; the middle dimension is split, so that each task holds a few tiles.
- ``eigh`` of the scatter (dimensions squared, whatever the number of rows) runs on the driver.
- The tiles of all rows are laid out in a square grid and multiplied by a block-diagonal matrix
  with a copy of the whitening matrix for each column of the grid.  A grid spreads over all
  partitions, where MLlib deals a single column of blocks to the square root of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix, Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, numbered

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, either way, count as this.
LARGEST = 1 << 46
#: Rows of a tile: at least so many, at most what fits into so many bytes, and else such that there are so many tiles.
TILE_ROWS, TILE_BYTES, TILES = 1 << 10, 16 << 20, 1 << 16
#: Tiles whose products one task sums.
TILES_A_TASK = 8
#: A component counts if its eigenvalue is over this share of the largest.
LEAST_SHARE = 1e-12


def quantised(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry, as longs; null for a null vector or one with a null or non-finite entry."""
    doubles = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(doubles, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    whole = F.transform(doubles, lambda c: F.floor(F.greatest(F.least(SCALE * c, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long") + SHIFT)
    return F.when(sound, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by dimension, of a thousand rows at a time so that none overflows."""
    for batch in batches:
        x = _matrix(batch.column("x"))
        for at in range(0, len(x), 1000):
            sums = x[at : at + 1000].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["dim", "s"])


def _centred(n: int, sums: list[int]):
    """(index, id, deviation, centred): sum of (n * x - S)^2, null beyond a long, and (n * x - S) / n."""
    base = [s // n for s in sums]
    rest = [s - n * b for s, b in zip(sums, base, strict=True)]

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch.column("x")) - np.array(base, np.int64)
            widest = n * (int(np.abs(near).max(initial=0)) + 1)
            exact = widest < 1 << 62
            d = n * (near if exact else near.astype(object)) - np.array(rest, np.int64 if exact else object)
            if near.shape[1] * widest**2 < 1 << 62:
                deviation = pa.array((d * d).sum(axis=1))
            else:
                whole = d.astype(object)
                deviation = pa.array([s if s < 1 << 63 else None for s in (whole * whole).sum(axis=1).tolist()], pa.int64())
            centred = np.array(d / n, np.float64)
            offsets = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("index"), batch.column("id"), deviation, pa.ListArray.from_arrays(offsets, pa.array(centred.ravel()))], ["index", "id", "deviation", "centred"])

    return centre


def _tile_rows(rows: int, dims: int) -> int:
    return max(1, min(max(TILE_ROWS, rows // TILES), TILE_BYTES // (8 * dims)))


def _tiles(rows: DataFrame, height: int, dims: int) -> Any:
    """An RDD of (number, matrix): the vectors ``v`` of ``height`` consecutive indices each; the last is filled up with zeros."""

    def lay(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        tile = np.zeros((height, dims))
        tile[table.column("index").to_numpy() % height] = _matrix(table.column("v").combine_chunks())
        return pa.table({"number": [key[0].as_py()], "values": [tile.ravel(order="F")]})

    by_tile = rows.select(F.expr(f"index div {height}L").alias("number"), "index", "v").groupBy("number")
    return by_tile.applyInArrow(lay, "number long, values array<double>").rdd.map(lambda r: (r.number, DenseMatrix(height, dims, r["values"])))


def _product(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``a.multiply(b)`` with the middle dimension split, which the Python method has no parameter for."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def scatter(rows: DataFrame, count: int, dims: int) -> np.ndarray:
    """The sum of outer products of the vectors ``v``, whose ``index`` runs from 0 to ``count`` - 1."""
    height = _tile_rows(count, dims)
    number = -(-count // height)
    tall = BlockMatrix(_tiles(rows, height, dims).map(lambda t: ((t[0], 0), t[1])), height, dims, number * height, dims)
    return _product(tall.transpose(), tall, -(-number // TILES_A_TASK)).toLocalMatrix().toArray()


def project(rows: DataFrame, count: int, matrix: np.ndarray) -> DataFrame:
    """(index, v): each vector ``v`` of ``rows`` times ``matrix``."""
    dims, wide = matrix.shape
    height = _tile_rows(count, dims)
    side = math.isqrt(max(0, -(-count // height) - 1)) + 1  # the grid's rows and columns
    context = rows.sparkSession.sparkContext
    grid = BlockMatrix(_tiles(rows, height, dims).map(lambda t: ((t[0] // side, t[0] % side), t[1])), height, dims, side * height, side * dims)
    values = context.broadcast(matrix.ravel(order="F").tolist())
    diagonal = context.parallelize(range(side), min(side, 64)).map(lambda j: ((j, j), Matrices.dense(dims, wide, values.value)))
    product = grid.multiply(BlockMatrix(diagonal, dims, wide, side * dims, side * wide))

    def lines(block: tuple[tuple[int, int], DenseMatrix]) -> Iterator[tuple[int, list[float]]]:
        (i, j), m = block
        first = (i * side + j) * height
        for k, line in enumerate(m.toArray()[: max(0, count - first)].tolist()):
            yield first + k, line

    return rows.sparkSession.createDataFrame(product.blocks.flatMap(lines), "index long, v array<double>")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every sound row and component.

    Rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are
    vectors of another length than most rows have (of equally frequent lengths the longer counts).
    Each entry c becomes floor(64 * c) + 1000000, with 64 * c held within 2^46.  Means and covariance
    are those of the distinct vectors (divisor n, their number), so repeated rows count once and
    all get the same values.  Components are numbered by falling eigenvalue and given while it
    is over ``LEAST_SHARE`` of the largest: with one distinct vector there is none, and no row.
    ``deviation`` is null where it doesn't fit a long.  Ids may be null or repeat, other columns
    are ignored, and an empty table gives none.
    """
    spark = embeddings.sparkSession
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sound = embeddings.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("x")).where("size(x) > 0")
    lengths = sound.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths.dims
    rows = cut(numbered(sound.where(F.size("x") == dims), "index"))
    fit = numbered(rows.groupBy("x").agg(F.min("index").alias("row")), "place").select("row", "place", "x")
    fit = cut(fit)
    by_dim = fit.mapInArrow(_sums, "dim int, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums, n = {r.dim: int(r.s) for r in by_dim.collect()}, fit.count()  # a row a dimension
    centred = cut(rows.mapInArrow(_centred(n, [sums[i] for i in range(dims)]), "index long, id long, deviation long, centred array<double>"))
    vectors = centred.select("index", F.col("centred").alias("v"))

    def fitted(values: DataFrame) -> DataFrame:
        """The rows of the fit list, numbered by their place in it."""
        return values.join(fit.select(F.col("row").alias("index"), "place"), "index").select(F.col("place").alias("index"), "v")

    covariance = scatter(fitted(vectors), n, dims) / n
    share, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    share, axes = share[::-1], axes[:, ::-1]
    held = int((share[:components] > max(share[0], 0) * LEAST_SHARE).sum())
    if not held:
        return spark.createDataFrame([], schema)
    explained = (share[:held] / share.sum()).tolist()
    whitened = cut(project(vectors, rows.count(), axes[:, :held] / np.sqrt(share[:held])))
    error = float(np.abs(scatter(fitted(whitened), n, held) / n - np.eye(held)).max())
    shares = F.array(*(F.lit(x) for x in explained))
    out = centred.select("index", "id", "deviation").join(whitened, "index").select("id", "deviation", F.posexplode("v").alias("at", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
