"""Best-fit packing of documents into fixed-length sequences by a linear grouping scheme.

A document of n tokens (white-space words plus one separator) fills ``ceil(n / capacity)`` pieces; all but the last are
full sequences. The rest is bin packing, solved in each shard:

1. large pieces (over ``capacity / 8``) are sorted and cut into ``GROUPS`` groups of equal cardinality, and every length is
   rounded up to its group's largest, which leaves few sizes;
2. the fewest bins over configurations of these sizes come from the configuration linear programme (column generation to the
   optimum, with a knapsack over integer lengths as the pricing step); whole multiples of its configurations are opened;
3. actual documents take the slots of their group, so every rounded configuration stays feasible;
4. what rounding down left over, and all small pieces, go in best-fit order (longest first) into the actual gaps.

Scale: only (doc_id, length) is shuffled, once, into shards of about ``shard_rows`` rows; a shard needs constant memory
and shards are independent, so work is linear and any number of executors helps. Sharding costs at most one partly
filled bin plus the scheme's additive term for each shard of ``shard_rows`` documents.

Defined results: null, empty and blank texts hold no tokens and take no place; a text of any length is cut into pieces that all have a
place; rows with null doc_id and repeated rows are packed as rows of their own, spread over the shards like any others; equal
lengths are ordered by doc_id; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUPS = 16
LARGE = 8  # a piece is large over capacity / LARGE
SHARD_ROWS = 200_000
SCHEMA = "bin_id long, slot int, doc_id long, piece int, first_token long, n_tokens int"


def n_tokens(text: Column) -> Column:
    """White-space words and one separator; 0 for null and blank texts."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(text.isNull() | (n == 0), F.lit(0)).otherwise(n + 1).cast("long")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(bin_id, slot, doc_id, piece, first_token, n_tokens): where each piece of each document goes."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    shards = max(1, math.ceil(docs.count() / shard_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_tokens(F.col("text")).alias("n")).where("n > 0")
    # the row's number is part of the hash, so that very many rows of one doc_id don't meet in one shard
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _shard(key[0].as_py(), shards, table, capacity)

    return rows.groupBy("shard").applyInArrow(solve, SCHEMA)


def _shard(shard: int, shards: int, table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("n", "descending"), ("doc_id", "ascending")])
    n = table["n"].to_numpy()
    pieces = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(capacity, n[row] - piece * capacity).astype(np.int64)
    bins = pack_lengths(length, capacity)
    order = np.lexsort((np.arange(len(row)), bins))
    bins, row, piece, length = bins[order], row[order], piece[order], length[order]
    begins = np.searchsorted(bins, bins)
    return pa.table(
        {
            "bin_id": pa.array(bins * shards + shard, pa.int64()),
            "slot": pa.array(np.arange(len(bins)) - begins, pa.int32()),
            "doc_id": table["doc_id"].take(pa.array(row)),
            "piece": pa.array(piece, pa.int32()),
            "first_token": pa.array(piece * capacity, pa.int64()),
            "n_tokens": pa.array(length, pa.int32()),
        }
    )


def pack_lengths(length: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each length (1..capacity)."""
    length = np.asarray(length, np.int64)
    bins = np.full(len(length), -1, np.int64)
    order = np.argsort(-length, kind="stable")
    full = order[length[order] == capacity]
    bins[full] = np.arange(len(full))
    opened = len(full)
    rest = order[len(full) :]
    large = rest[length[rest] * LARGE > capacity]
    gaps: list[int] = []
    if len(large):
        # 1: equal cardinality, rounded up; groups that round to the same size are one.
        each = -(-len(large) // GROUPS)
        ceiling = length[large[(np.arange(len(large)) // each) * each]]
        sizes, group = np.unique(-ceiling, return_inverse=True)
        sizes = -sizes
        demand = np.bincount(group)
        # 2
        patterns, times = configurations(sizes, demand, capacity)
        # 3: the longest pieces of a group first; a slot beyond the demand stays empty.
        queue = [large[group == g].tolist()[::-1] for g in range(len(sizes))]
        for pattern, count in zip(patterns, times):
            slots = np.repeat(np.arange(len(sizes)), pattern).tolist()
            for _ in range(count):
                left, used = capacity, False
                for g in slots:
                    if queue[g]:
                        i = queue[g].pop()
                        bins[i], left, used = opened, left - int(length[i]), True
                if used:
                    gaps.append(left)
                    opened += 1
    # 4
    todo = rest[bins[rest] < 0]
    best_fit(todo, length, bins, gaps, opened - len(gaps), capacity)
    return bins


def best_fit(todo: np.ndarray, length: np.ndarray, bins: np.ndarray, gaps: list[int], first: int, capacity: int) -> None:
    """Each of ``todo``, longest first, into the open bin with the smallest gap that holds it; else into a new bin."""
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit g is set where some bin has the gap g
    for k, gap in enumerate(gaps):
        by_gap[gap].append(first + k)
        filled |= 1 << gap
    new = first + len(gaps)
    for i, n in zip(todo.tolist(), length[todo].tolist()):
        fits = filled >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                filled ^= 1 << gap
        else:
            gap, b, new = capacity, new, new + 1
        bins[i] = b
        by_gap[gap - n].append(b)
        filled |= 1 << (gap - n)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: how many of each size) and how often each is used: the configuration LP, rounded down."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    known: set[bytes] = set()
    while True:
        value = np.linalg.solve(basis.T, np.ones(m))
        best, pattern = knapsack(sizes, value, capacity)
        if best <= 1 + 1e-9 or pattern.tobytes() in known:  # optimal; a pattern that comes again gains by rounding errors only
            break
        known.add(pattern.tobytes())
        x, d = np.linalg.solve(basis, np.column_stack([demand, pattern])).T
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
    x = np.linalg.solve(basis, demand.astype(float))
    return basis.T.round().astype(np.int64), np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)


def knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable pattern that fits: rounds of one further piece, each vectorised over all lengths."""
    best = np.zeros(capacity + 1)
    came: list[np.ndarray] = []
    for _ in range(capacity // int(sizes.min())):
        longer, by = best.copy(), np.full(capacity + 1, -1)
        for k, (s, v) in enumerate(zip(sizes.tolist(), value.tolist())):
            better = best[: capacity + 1 - s] + v > longer[s:] + 1e-12
            longer[s:][better] = best[: capacity + 1 - s][better] + v
            by[s:][better] = k
        if (by < 0).all():
            break
        came.append(by)
        best = longer
    pattern, at = np.zeros(len(sizes)), capacity
    for by in reversed(came):
        if by[at] >= 0:
            pattern[by[at]] += 1
            at -= int(sizes[by[at]])
    return float(best[capacity]), pattern


#: Tokens and pieces of each document, wherever they are.
TOTALS_SQL = rf"""
WITH n AS (SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) + 1 AS n FROM documents)
SELECT doc_id, n AS tokens, CAST(ceil(n / {CAPACITY}.0) AS BIGINT) AS pieces FROM n WHERE n > 1
"""
