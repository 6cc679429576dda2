"""Embedding near-dedup: which vectors have others at cosine similarity ``THRESHOLD`` or more, by int8 tile products with error bounds.

Equal vectors collapse to one class first, so copies, however many, cost nothing later. The classes are hashed into equal blocks; each
pair of blocks is one tile. In a tile every vector v (scaled to length 1) becomes int8 codes q and a scale s, with the exact
length e of the residual v - s q. For two vectors |v.w - s_v s_w (q_v.q_w)| <= (1 + e_v) e_w + e_v, so a pair whose quantised product
(float32 BLAS on small integers, exact up to 1024 dimensions at a time) plus this bound is below the threshold is provably no
match. Only pairs that may reach the threshold are computed again in double precision. Nothing is approximate.

A tile returns, for each class, the weight of the classes it is linked to, and a spanning forest of the links: never the pairs
themselves, of which a group of n near copies has n * n / 2. The result has one row for each vec_id: its class (the lowest vec_id
that links lead to) and the number of its links.

Scale: tiles are independent tasks of equal size, however the vectors are distributed, and hold ``TILE_BYTES`` of vectors a side; the
number of tiles is what an exact search over N vectors costs. A class goes once to each tile of its block.

Defined results: null, empty, zero and non-finite vectors (or with null elements) match nothing and are a class of their own; vectors
of different lengths don't match; null ids are ignored; vectors may differ in length, direction decides; repeated rows are one; an
id with several vectors is in the class of all of them, and its links are those of each; a similarity equal to the threshold is a link;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import components

THRESHOLD = 0.95
TILE_BYTES = 16_000_000
STRIP, STRETCH = 512, 4096
_SLACK = 1e-9
_EXACT = 1024  # 1024 * 127 * 127 < 2**24


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and residual length of each row of length 1."""
    s = np.abs(unit).max(1) / 127
    q = np.rint(unit / s[:, None])
    return q.astype(np.int8), s, np.linalg.norm(unit - s[:, None] * q, axis=1) + _SLACK


def possible(qa: np.ndarray, sa: np.ndarray, ea: np.ndarray, qb: np.ndarray, sb: np.ndarray, eb: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose similarity may reach the threshold, by codes and bounds alone; at most ``STRIP * STRETCH`` at a time."""
    for at in range(0, len(qa), STRIP):
        strip = slice(at, at + STRIP)
        fa = qa[strip].astype(np.float32)
        for to in range(0, len(qb), STRETCH):
            stretch = slice(to, to + STRETCH)
            fb = qb[stretch].astype(np.float32).T
            product = fa[:, :_EXACT] @ fb[:_EXACT]
            for d in range(_EXACT, fa.shape[1], _EXACT):
                product = product.astype(np.float64) + fa[:, d : d + _EXACT] @ fb[d : d + _EXACT]
            # one bound for each row first; float32 rounding of the scaled product is far below 1e-5
            product *= sb[stretch].astype(np.float32)
            low = (threshold - ea[strip] - (1 + ea[strip]) * float(eb[stretch].max())) / sa[strip] * (1 - 1e-6) - 1e-5
            i, j = np.nonzero(product >= low[:, None].astype(np.float32))
            for k in range(0, len(i), 100_000):
                x, y = i[k : k + 100_000] + at, j[k : k + 100_000] + to
                whole = (qa[x].astype(np.int64) * qb[y]).sum(1)
                ok = sa[x] * sb[y] * whole + (1 + ea[x]) * eb[y] + ea[x] >= threshold - _SLACK
                if ok.any():
                    yield x[ok], y[ok]


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j, pair by pair, in the forest ``root`` (in place; a root is the lowest of its tree)."""
    while len(i):
        while (root[root] != root).any():
            root[:] = root[root]
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


_TILE = "node long, links long, root long"


def tile_links(table: pa.Table, threshold: float) -> pa.Table:
    """(node, links, root): of one tile, the weight that each node is linked to and a node it leads to."""
    block, own = table["block"].to_numpy(), table["tile_a"][0].as_py()
    node, weight = table["node"].to_numpy(), table["weight"].to_numpy()
    v = np.frombuffer(b"".join(table["v"].to_pylist()), np.float32 if table["single"][0].as_py() else np.float64).reshape(len(node), -1)
    unit = v.astype(np.float64)
    unit /= np.abs(unit).max(1)[:, None]
    length = np.linalg.norm(unit, axis=1)
    q, s, e = quantised(unit / length[:, None])
    first = np.flatnonzero(block == own)
    alone = table["tile_b"][0].as_py() == own
    second = first if alone else np.flatnonzero(block != own)
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    if len(first) and len(second):
        for i, j in possible(q[first], s[first], e[first], q[second], s[second], e[second], threshold):
            i, j = first[i], second[j]
            if alone:
                i, j = i[i < j], j[i < j]
            near = np.einsum("ij,ij->i", unit[i], unit[j]) / (length[i] * length[j]) >= threshold
            i, j = i[near], j[near]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            unite(root, i, j)
        while (root[root] != root).any():
            root = root[root]
    some = np.flatnonzero(links > 0)
    return pa.table({"node": node[some], "links": links[some], "root": node[root[some]]})


@F.arrow_udf(T.StructType([T.StructField("v", T.BinaryType()), T.StructField("single", T.BooleanType())]))
def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The bytes of each vector, 0.0 for -0.0; null for vectors that match nothing."""
    kind = pa.struct([("v", pa.binary()), ("single", pa.bool_())])
    for vectors in batches:
        single = vectors.type.value_type == pa.float32()
        number = np.float32 if single else np.float64
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        flat = vectors.flatten().cast(pa.float32() if single else pa.float64()).to_numpy(zero_copy_only=False) + number(0)  # null elements become NaN
        good = np.concatenate([[0], np.cumsum(np.isfinite(flat))])
        some = np.concatenate([[0], np.cumsum(flat != 0)])
        ok = (sizes > 0) & (good[ends[1:]] - good[ends[:-1]] == sizes) & (some[ends[1:]] > some[ends[:-1]])
        width, blob = flat.itemsize, pa.py_buffer(np.ascontiguousarray(flat, number))
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(vectors), [None, pa.py_buffer(ends * width), blob]).cast(pa.binary())
        yield pa.StructArray.from_arrays([raw, pa.array(np.full(len(vectors), single))], fields=list(kind), mask=pa.array(~ok))


def links(vectors: DataFrame, threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(vec_id, class_id, n_links) of every vec_id."""
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), packed(F.col("embedding")).alias("p"))
    rows = cut(rows.select("vec_id", "p.v", "p.single").distinct())
    # classes of equal vectors, with a number that stays
    grouped = rows.where("v is not null").groupBy("v", "single").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("node"), "*"))
    size = classes.agg(F.count(F.lit(1)), F.max(F.length("v"))).first()
    # by bytes; for a small table a tile for each core
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(size[0] * (size[1] or 1) / tile_bytes), min(size[0] // 2000, math.ceil(math.sqrt(2 * cores))))
    placed = classes.select(
        "node", "weight", "v", "single", F.length("v").alias("bytes"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    ).select("*", F.least("block", "other").alias("tile_a"), F.greatest("block", "other").alias("tile_b"))

    def solve(table: pa.Table) -> pa.Table:
        return tile_links(table, threshold)

    found = cut(placed.groupBy("bytes", "tile_a", "tile_b").applyInArrow(solve, _TILE))
    # every class of an id that has several vectors is one
    members = rows.where("v is not null").join(classes.select("v", "single", "node", "weight"), ["v", "single"]).select("vec_id", "node", "weight")
    several = members.groupBy("vec_id").agg(F.min("node").alias("u"), F.max("node").alias("top")).where("u < top").select("vec_id", "u")
    bridges = members.join(several, "vec_id").where("node <> u").select("u", F.col("node").alias("v"))
    rooted = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(bridges))
    lowest = classes.select("node", "low").join(rooted, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    named = lowest.select("node", "root").join(lowest.groupBy("root").agg(F.min("low").alias("class_id")), "root").select("node", "class_id")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = members.join(named, "node").join(counted, "node", "left").groupBy("vec_id")
    known = known.agg(F.min("class_id").alias("class_id"), F.sum(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    ids = rows.select("vec_id").distinct().join(known, "vec_id", "left")
    return ids.select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def sql(threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
class AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, least(vec_id, coalesce(low, vec_id)) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM v LEFT JOIN class c ON c.a = vec_id LEFT JOIN links l ON l.a = vec_id
"""
