"""Matrix operators in long form, (row, column, value) rows, and between rows of vectors.

A matrix of any size is a table; products are joins on the inner index and sums, so Spark partitions them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TensorError


def long_form(df: DataFrame, row: str, vector: str) -> DataFrame:
    """(i, j, v) of a table with one vector a row; j counts from 0."""
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(F.col(vector).cast("array<double>")).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


def from_values(spark: SparkSession, values: Sequence[float], rows: int, columns: int) -> DataFrame:
    """(i, j, v) of row-major values; their number must be that of the shape."""
    if rows < 0 or columns < 0 or len(values) != rows * columns:
        raise TensorError(f"{len(values)} values don't fill {rows} x {columns}")
    return spark.createDataFrame([(k // columns, k % columns, float(x)) for k, x in enumerate(values)], "i long, j long, v double")


def full(spark: SparkSession, rows: int, columns: int, value: float) -> DataFrame:
    """(i, j, v) with the same value everywhere: generated by the executors, so of any size."""
    if rows < 0 or columns < 0:
        raise TensorError("a dimension can't be negative")
    cells = spark.range(rows * columns)
    return cells.select(F.floor(F.col("id") / max(columns, 1)).alias("i"), (F.col("id") % max(columns, 1)).alias("j"), F.lit(float(value)).alias("v"))


def zeros(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    return full(spark, rows, columns, 0.0)


def ones(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    return full(spark, rows, columns, 1.0)


def get(matrix: DataFrame, i: int, j: int) -> DataFrame:
    """(v): one cell; no row outside the shape. The filter reaches the scan."""
    return matrix.where((F.col("i") == i) & (F.col("j") == j)).select("v")


def set_cell(matrix: DataFrame, i: int, j: int, value: float) -> DataFrame:
    """The matrix with one cell changed; unchanged if it has no such cell."""
    here = (F.col("i") == i) & (F.col("j") == j)
    return matrix.select("i", "j", F.when(here, F.lit(float(value))).otherwise(F.col("v")).alias("v"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equal): one row, whether both have the same cells with the same values; NaN equals nothing."""
    both = a.select("i", "j", F.col("v").alias("__a")).join(b.select("i", "j", F.col("v").alias("__b")), ["i", "j"], "full")
    odd = F.coalesce((F.col("__a") != F.col("__b")) | F.isnan("__a") | F.isnan("__b"), F.lit(True))
    return both.agg((F.coalesce(F.max(odd.cast("int")), F.lit(0)) == 0).alias("equal"))


def shape(matrix: DataFrame) -> DataFrame:
    """(rank, rows, columns, numel) of a dense matrix that begins at (0, 0)."""
    n = F.coalesce(F.max("i") + 1, F.lit(0)).cast("long"), F.coalesce(F.max("j") + 1, F.lit(0)).cast("long")
    return matrix.agg(F.lit(2).alias("rank"), n[0].alias("rows"), n[1].alias("columns")).withColumn("numel", F.col("rows") * F.col("columns"))


def vectors(matrix: DataFrame) -> DataFrame:
    """(i, vector) from long form."""
    cells = F.array_sort(F.collect_list(F.struct("j", "v")))
    return matrix.groupBy("i").agg(cells.getField("v").alias("vector"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def reshape(matrix: DataFrame, columns: int, new_columns: int) -> DataFrame:
    """Row-major cells of a matrix of ``columns`` columns as one of ``new_columns``."""
    if columns < 1 or new_columns < 1:
        raise TensorError("a matrix has at least one column")
    flat = F.col("i") * columns + F.col("j")
    return matrix.select(F.floor(flat / new_columns).cast("long").alias("i"), (flat % new_columns).alias("j"), "v")


def flat_index(index: list[Column], dims: list[int]) -> Column:
    """Row-major position of a multi-index; null outside the shape."""
    if len(index) != len(dims):
        raise TensorError("an index needs one entry for each dimension")
    place, inside = F.lit(0).cast("long"), F.lit(True)
    for k, n in zip(index, dims):
        place, inside = place * n + k, inside & (k >= 0) & (k < n)
    return F.when(inside, place)


def slice_first(matrix: DataFrame, i: int) -> DataFrame:
    """(j, v): one row; the filter reaches the scan."""
    return matrix.where(F.col("i") == i).select("j", "v")


def stack(*parts: DataFrame) -> DataFrame:
    """(k, i, j, v): matrices under a new first index."""
    if not parts:
        raise TensorError("nothing to stack")
    out = parts[0].withColumn("k", F.lit(0).cast("long"))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("k", F.lit(k).cast("long")))
    return out.select("k", "i", "j", "v")


def add_bias(matrix: DataFrame, bias: DataFrame) -> DataFrame:
    """v + b[j]."""
    return matrix.join(bias.select("j", F.col("v").alias("__b")), "j").select("i", "j", (F.col("v") + F.col("__b")).alias("v"))


def add_broadcast(matrix: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """v + w, where w has only the dimensions ``on``; the result has the shape of ``matrix``."""
    return matrix.join(other.select(*on, F.col("v").alias("__w")), on).select("i", "j", (F.col("v") + F.col("__w")).alias("v"))


def mul_broadcast_last(matrix: DataFrame, factors: DataFrame) -> DataFrame:
    """v * f[i]: one factor for each row, spread over its last dimension."""
    return matrix.join(factors.select("i", F.col("v").alias("__f")), "i").select("i", "j", (F.col("v") * F.col("__f")).alias("v"))


def sum_axis(matrix: DataFrame, axis: int) -> DataFrame:
    """Sums that remove dimension ``axis`` (0: rows, 1: columns); partial sums before the shuffle."""
    if axis not in (0, 1):
        raise TensorError(f"no axis {axis}")
    left = "ji"[axis]
    return matrix.groupBy(left).agg(F.sum("v").alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum over k of a(i, k) b(k, j), by a join on k and partial sums."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def batched_matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same for each batch index ``b`` of (b, i, j, v) tables."""
    left = a.select("b", "i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select("b", F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, ["b", "k"]).groupBy("b", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gram(df: DataFrame, vector: str, by: list[str] | None = None) -> DataFrame:
    """([by,] i, j, v): sum over all rows of x_i x_j. One narrow pass with partial sums; only dim**2 cells are shuffled."""
    by = by or []
    x = F.col(vector).cast("array<double>")
    one = df.select(*by, x.alias("__x"), F.posexplode(x).alias("i", "__xi"))
    two = one.select(*by, F.col("i").cast("long").alias("i"), "__xi", F.posexplode("__x").alias("j", "__xj"))
    return two.groupBy(*by, "i", F.col("j").cast("long").alias("j")).agg(F.sum(F.col("__xi") * F.col("__xj")).alias("v"))
