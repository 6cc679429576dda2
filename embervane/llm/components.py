"""Connected components by alternating large-star and small-star rounds, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u bigint, v bigint); root is the lowest node of the component.

    Each round is a shuffle by node, with minima summed up before it, so the centre of a large star is a row of each task, and a
    join that a hot centre's rows can be split in. Rounds are checkpointed, so lineage stays short; their number is logarithmic
    in the component sizes. Loops, repeated and null edges are ignored; an empty input gives an empty result.
    """
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    now = cut(_ordered(edges.where("u is not null and v is not null")))
    state = _state(now)
    while True:
        # large star: every larger neighbour of u (and u's own link) goes to the lowest of u's neighbourhood
        mirrored = now.select(F.explode(both).alias("e")).select("e.u", "e.v")
        large = _with_lowest(mirrored).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = _ordered(large)
        # small star: u and its smaller neighbours go to the lowest of them
        small = _with_lowest(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(_ordered(small.select("e.u", "e.v")))
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def _with_lowest(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the lowest neighbour of u."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops, the larger node first."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0
