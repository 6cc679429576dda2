"""Pooling of token vectors to one vector for each text or group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(rows: DataFrame, by: str, vector: str, mask: str | None = None) -> DataFrame:
    """(by, d, v): mean by element over rows whose mask is 1, the count at least 1e-9."""
    kept = rows if mask is None else rows.where(F.col(mask) == 1)
    cells = kept.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
    out = cells.groupBy(by, F.col("d").cast("long").alias("d")).agg((F.sum("x") / F.greatest(F.count("x").cast("double"), F.lit(1e-9))).alias("v"))
    if mask is None:
        return out
    # groups without any kept row pool to zero
    every = rows.select(by, F.posexplode(F.col(vector)).alias("d", "_")).select(by, F.col("d").cast("long").alias("d")).distinct()
    return every.join(out, [by, "d"], "left").select(by, "d", F.coalesce("v", F.lit(0.0)).alias("v"))


def cls_pool(rows: DataFrame, by: str, position: str, vector: str) -> DataFrame:
    """(by, vector): the vector at the lowest position; one partial aggregate, no sort."""
    return rows.groupBy(by).agg(F.min_by(vector, position).alias(vector))
