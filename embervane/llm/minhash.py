"""MinHash near-dedup with sequential Bayesian verification.

1. Text is lower-cased and cut into words (runs without white space or ASCII punctuation); its 3-word shingles are hashed
   with numpy over Arrow buffers and 120 MinHash values of 16 bits are kept. Texts with the same words collapse to one node
   here, so exact copies, however many, cost nothing later. A node's key is a hash of a 128-bit digest of its words; keys that
   two digests share (a handful among 10^10 texts) are found and replaced, so no two texts are ever one by chance.
2. 40 bands of 3 values give candidates (a pair of similarity 0.5 is missed with probability 0.005). In a bucket every node
   meets the lowest one and its 8 predecessors, which is every pair of a bucket of up to 9. Larger buckets are then cut
   into equal block tiles in which all pairs meet, but those that are in one component by then. A bucket of more than ``HOT``
   nodes is sorted in parts of about that size.
3. Candidates compare their signatures batch by batch; under a uniform prior the posterior of the similarity is a Beta, and
   a pair is dropped as soon as the probability that it reaches the threshold falls under ``miss`` over the number of batches,
   so that all batches together miss at most ``miss``.
4. Survivors are verified exactly on their shingle sets.
5. Verified pairs are joined to groups by connected components; the lowest doc_id of each stays.

Scale: shuffles carry signatures (240 bytes a distinct text) and band hashes (16 bytes each); text is shuffled only to verify
survivors. Nothing is broadcast or collected but fixed tables and counters. The work on a crowded bucket grows with the square
of its nodes, unless they are one component: tiles of ``TILE`` nodes a side are independent and of equal size, and shingle
sets go to the tiles that need them, not to each pair.

Defined results: null texts and texts without words join no group and are kept; texts of one or two words have a single
shingle, very long ones all of theirs; repeated rows are copies (one is kept); a null doc_id sorts last within its group; a pair
exactly at the threshold is near; further columns pass unchanged, whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHash, buffers, cut, fresh, lean, mix, once, small_batches, steps, words
from .components import components

THRESHOLD = 0.5
MISS = 0.005
SHINGLE = 3
BANDS, ROWS = 40, 3
HASHES = BANDS * ROWS
BATCH = 8
_TILE = ["bucket", "tile_a", "tile_b"]
_ARROW_TILE = {"bucket": pa.int64(), "tile_a": pa.int32(), "tile_b": pa.int32()}
NEIGHBOURS = 8
HOT = 50_000  # nodes of a bucket that are sorted together
TILE = 512
_MULTIPLIERS = np.random.default_rng(20240607).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_WORDLESS = (np.arange(128) < 48) | ((np.arange(128) > 57) & (np.arange(128) < 97)) | (np.arange(128) > 122)
_BLANK = np.concatenate([_WORDLESS, np.zeros(128, bool)])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and the first word of each row."""
    start, end, first = words(data, offsets, _BLANK[data])
    return SpanHash(data).of(start, end), first


def shingles(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order and the first shingle of each row; a shorter text has one shingle."""
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(first[:-1] - ends[:-1], count)
    last = np.repeat(first[1:], count)
    padded = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    h = padded[at] * _STEPS[0]
    for k in range(1, SHINGLE):
        h += np.where(at + k < last, padded[at + k] * _STEPS[k], np.uint64(k))
    return mix(h), ends


def digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """128-bit digest of the words of each row, one blank between them; None without words."""
    blank = _BLANK[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank after a word
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    keep[inner] = ~blank[inner]
    plain = memoryview(np.where(blank, np.uint8(32), data)[keep])
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    # a row's last blank isn't between words
    stop = ends[1:] - ((ends[1:] > ends[:-1]) & blank[np.maximum(offsets[1:] - 1, 0)] if len(data) else 0)
    return [xxhash.xxh3_128_digest(plain[i:j]) if j > i else None for i, j in zip(ends[:-1].tolist(), stop.tolist())]


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """(digest, signature, valid) of each row; signatures are MinHash values as uint16."""
    rows = len(offsets) - 1
    word, first = word_hashes(data, offsets)
    valid = np.diff(first) > 0
    out = np.zeros((rows, HASHES), np.uint16)
    if len(word):
        some = np.flatnonzero(valid)
        h, ends = shingles(word, first)
        buffer, begin = np.empty_like(h), ends[some]
        for j in range(HASHES):
            np.multiply(h, _MULTIPLIERS[j], out=buffer)
            out[some, j] = mix(np.minimum.reduceat(buffer, begin)).astype(np.uint16)
    return digests(data, offsets), out, valid


@F.arrow_udf(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())]))
@lean
def signature_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    none = pa.scalar(None, pa.binary())
    for texts in batches:
        data, offsets = buffers(texts)
        names, blobs = [pa.array([], pa.binary())], [pa.array([], pa.binary())]
        for a, b in steps(offsets):
            digest, sig, ok = signatures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            names.append(pa.array(digest, pa.binary()))
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * HASHES), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))])
            blobs.append(pa.compute.if_else(pa.array(ok), blob.cast(pa.binary()), none))
        yield pa.StructArray.from_arrays([pa.concat_arrays(names), pa.concat_arrays(blobs)], ["digest", "sig"])


@once
@F.arrow_udf(T.BinaryType())
@lean
def digest_udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The digest alone; the same as ``signature_udf`` gives."""
    for texts in batches:
        data, offsets = buffers(texts)
        parts = [pa.array([], pa.binary())]
        for a, b in steps(offsets):
            parts.append(pa.array(digests(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), pa.binary()))
        yield pa.concat_arrays(parts)


class Keys:
    """bigint keys of digests: a hash of ``bits`` bits, and another one for the keys that several digests share; null for null."""

    def __init__(self, bits: int = 64, shared: tuple[int, ...] = ()):
        self.bits, self.shared = bits, shared

    def of(self, digest: Column) -> Column:
        key = F.xxhash64(digest)
        key = key if self.bits == 64 else key.bitwiseAND(F.lit((1 << self.bits) - 1))
        key = F.when(key.isin(list(self.shared)), F.xxhash64(F.lit("again"), digest)).otherwise(key) if self.shared else key
        return F.when(digest.isNotNull(), key)


@F.arrow_udf(T.BinaryType())
@lean
def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Sorted distinct shingle hashes of each text."""
    for texts in batches:
        data, offsets = buffers(texts)
        out: list[bytes] = []
        for a, b in steps(offsets):
            h, ends = shingles(*word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            out += [np.unique(h[i:j]).tobytes() for i, j in zip(ends[:-1], ends[1:])]
        yield pa.array(out, pa.binary())


@F.arrow_udf(T.DoubleType())
def jaccard(left: pa.Array, right: pa.Array) -> pa.Array:
    out = np.zeros(len(left))
    for i, (a, b) in enumerate(zip(left, right)):
        out[i] = similarity(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))
    return pa.array(out)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def least_matches(threshold: float, miss: float, batch: int = BATCH, hashes: int = HASHES) -> np.ndarray:
    """For n = batch, 2 batch, ...: the fewest matches m with P(similarity >= threshold | m of n) >= miss, prior uniform."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    least, miss = [], miss * batch / hashes  # the share of each batch
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= threshold].sum() >= miss * density.sum():
                break
        least.append(m)
    return np.array(least)


def survivors_udf(threshold: float, miss: float):
    least = least_matches(threshold, miss)

    @F.arrow_udf(T.BooleanType())
    def survives(left: pa.Array, right: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(left.to_pylist()), np.uint16).reshape(len(left), HASHES)
        y = np.frombuffer(b"".join(right.to_pylist()), np.uint16).reshape(len(right), HASHES)
        alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k, m in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches[alive] += (x[alive, part] == y[alive, part]).sum(1)
            alive = alive[matches[alive] >= m]
        out = np.zeros(len(x), bool)
        out[alive] = True
        return pa.array(out)

    return survives


def tile_pairs(table: pa.Table, least: np.ndarray) -> pa.Table:
    """The pairs of one tile that are in different components and pass the sequential test, a < b."""
    where = {k: table[k][0].as_py() for k in _TILE}
    block, key, root = (table[k].to_numpy() for k in ("block", "key", "root"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(len(key), HASHES)
    first = np.flatnonzero(block == where["tile_a"])
    second = first if where["tile_b"] == where["tile_a"] else np.flatnonzero(block == where["tile_b"])
    i, j = np.nonzero(root[first][:, None] != root[second])
    i, j = first[i], second[j]
    if first is second:
        i, j = i[i < j], j[i < j]
    matches = np.zeros(len(i), np.int64)
    for k, m in enumerate(least):
        part = sig[:, k * BATCH : (k + 1) * BATCH]
        matches += (part[i] == part[j]).sum(1)
        alive = matches >= m
        i, j, matches = i[alive], j[alive], matches[alive]
    a, b = np.minimum(key[i], key[j]), np.maximum(key[i], key[j])
    return pa.table({**{k: pa.array(np.full(len(a), x), _ARROW_TILE[k]) for k, x in where.items()}, "a": a, "b": b})


def crowded_pairs(nodes: DataFrame, large: DataFrame, found: DataFrame, threshold: float, miss: float, tile: int = TILE) -> DataFrame:
    """(bucket, tile_a, tile_b, a, b): all pairs of crowded buckets between components that pass the sequential test."""
    least = least_matches(threshold, miss)
    rooted = large.join(found.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    rooted = cut(rooted)
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    blocks = F.ceil(F.col("n") / tile).cast("int")
    blocked = rooted.join(mixed.select("bucket", "n"), "bucket").select("bucket", "key", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("key", "bucket"), blocks).cast("int").alias("block"))
    placed = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", F.least("block", "other").alias("tile_a"), F.greatest("block", "other").alias("tile_b"), "block", "key", "root"
    )

    def solve(table: pa.Table) -> pa.Table:
        return tile_pairs(table, least)

    return placed.join(nodes, "key").groupBy(*_TILE).applyInArrow(solve, "bucket long, tile_a int, tile_b int, a long, b long")


def bands(nodes: DataFrame) -> DataFrame:
    """(bucket, key): one row for each node and band."""
    piece: Column = F.expr(f"substring(sig, b * {2 * ROWS} + 1, {2 * ROWS})")
    return nodes.select("key", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b")).select(F.xxhash64("b", piece).alias("bucket"), "key")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(bucket, key, n, lowest) of the buckets that several nodes share; partial counts first, so a hot bucket is a row of each task."""
    rows = bands(nodes)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lowest")).where("n > 1")
    return rows.join(sizes, "bucket")


def bucket_pairs(members: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct (a, b), a < b: each node of a bucket with the lowest and with its predecessors, in hot buckets those of its own part."""
    near = Window.partitionBy("bucket", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / hot))).orderBy("key")
    others = F.array("lowest", *[F.lag("key", k).over(near) for k in range(1, NEIGHBOURS + 1)])
    return (
        members.select("key", "lowest", others.alias("o"))
        .where("lowest < key")
        .select(F.explode(F.array_distinct("o")).alias("a"), F.col("key").alias("b"))
        .where("a is not null and a < b")
        .distinct()
    )


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, bits: int = 64, hot: int = HOT) -> tuple[DataFrame, DataFrame, Keys]:
    """(doc_id, key) of every row, (key, root): the group of every node that is near another one, and how keys are made."""
    small_batches(docs.sparkSession)
    keys = Keys(bits)
    signed = docs.select("doc_id", signature_udf(F.lower(F.col("text"))).alias("s"))
    signed = cut(signed.select("doc_id", "s.digest", "s.sig"))
    some = signed.where("digest is not null").select(keys.of(F.col("digest")).alias("key"), "digest", "sig")
    nodes = cut(some.groupBy("key").agg(F.first("sig").alias("sig"), F.min("digest").alias("low"), F.max("digest").alias("high")))
    # of n texts about n * n / 2**65 share a key
    keys = Keys(bits, tuple(r.key for r in nodes.where("low < high").select("key").toLocalIterator()))
    if keys.shared:
        nodes = cut(some.select(keys.of(F.col("digest")).alias("key"), "sig").groupBy("key").agg(F.first("sig").alias("sig")))
    nodes = nodes.select("key", "sig")
    members = cut(bucket_members(nodes))
    tested = cut(bucket_pairs(members, hot))
    edges = verified(docs, nodes, tested, threshold, miss, keys)
    found = components(edges)
    # buckets over the all-pairs size: every pair that isn't in one component yet
    large = members.where(F.col("n") > min(NEIGHBOURS + 1, hot)).select("bucket", "key")
    if not large.isEmpty():
        met = cut(crowded_pairs(nodes, large, found, threshold, miss))
        new = cut(met.groupBy("a", "b").agg(F.min(F.struct(*_TILE)).alias("t")).select("t.*", "a", "b").join(tested, ["a", "b"], "left_anti"))
        more = verified_tiles(docs, new, threshold, keys)
        if not more.isEmpty():
            found = components(edges.union(more))
    return signed.select("doc_id", keys.of(F.col("digest")).alias("key")), found.select(F.col("node").alias("key"), "root"), keys


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float, miss: float, keys: Keys) -> DataFrame:
    """(u, v): the pairs that pass the sequential test and then the exact one."""
    left = nodes.select(F.col("key").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("key").alias("b"), F.col("sig").alias("sig_b"))
    alive = pairs.join(left, "a").join(right, "b").where(survivors_udf(threshold, miss)(F.col("sig_a"), F.col("sig_b"))).select("a", "b")
    alive = cut(alive)
    if alive.isEmpty():
        return alive.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sets = shingle_sets(docs, alive, keys)
    x = sets.select(F.col("key").alias("a"), F.col("s").alias("sa"))
    y = sets.select(F.col("key").alias("b"), F.col("s").alias("sb"))
    exact = alive.join(x, "a").join(y, "b").where(jaccard(F.col("sa"), F.col("sb")) >= threshold)
    return cut(exact.select(F.col("a").alias("u"), F.col("b").alias("v")))


def shingle_sets(docs: DataFrame, pairs: DataFrame, keys: Keys) -> DataFrame:
    """(key, s): the shingle set of every node of ``pairs`` (a, b)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    low = F.lower(F.col("text"))
    texts = docs.select(digest_udf(low).alias("digest"), low.alias("low")).where("digest is not null").select(keys.of(F.col("digest")).alias("key"), "low").join(wanted, "key", "left_semi")
    return texts.groupBy("key").agg(F.first("low").alias("low")).select("key", shingle_set(F.col("low")).alias("s"))


def verified_tiles(docs: DataFrame, pairs: DataFrame, threshold: float, keys: Keys) -> DataFrame:
    """(u, v): the pairs that pass the exact test; a set goes once to each tile that holds pairs of it."""
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sides = [F.col(c).alias(f"of_{c}") for c in _TILE]
    placed = pairs.select(*sides, F.explode(F.array("a", "b")).alias("key")).distinct().join(shingle_sets(docs, pairs, keys), "key")

    def solve(own: pa.Table, sets: pa.Table) -> pa.Table:
        known = {k: np.frombuffer(s, np.uint64) for k, s in zip(sets["key"].to_pylist(), sets["s"].to_pylist())}
        a, b = own["a"].to_pylist(), own["b"].to_pylist()
        near = pa.array([similarity(known[x], known[y]) >= threshold for x, y in zip(a, b)], pa.bool_())
        return pa.table({"u": own["a"].filter(near), "v": own["b"].filter(near)})

    return cut(pairs.groupBy(*_TILE).cogroup(placed.groupBy(*[f"of_{c}" for c in _TILE])).applyInArrow(solve, "u long, v long").distinct())


def duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, bits: int = 64, hot: int = HOT) -> DataFrame:
    """(doc_id, duplicate_of, group_size): a row for each document that goes, with the one that stays in its place."""
    ids, found, _ = near_groups(docs, threshold, miss, bits, hot)
    numbered = ids.where("key is not null").withColumn("row", F.monotonically_increasing_id())  # of checkpointed rows: stable
    rooted = numbered.join(found, "key", "left").select("doc_id", "row", F.coalesce("root", "key").alias("root"))
    # partial sums first, so that a group of any size is one row of each task
    stays = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    groups = rooted.groupBy("root").agg(stays, F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    gone = rooted.join(groups, "root").where(F.col("row") != F.col("first.row"))
    return gone.select("doc_id", F.col("first.doc_id").alias("duplicate_of"), "group_size")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each group, and every text that is in none.

    The winner of each group, (key, lowest doc_id), is found on ids alone; then rows meet it by key, so text moves once.
    """
    ids, found, keys = near_groups(docs, threshold, miss)
    rooted = ids.where("key is not null").join(found, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    digest, key, rank, k, d = fresh(docs, "digest", "key", "rank", "k", "d")
    winners = rooted.groupBy("root").agg(first).select(F.col("first.key").alias(k), F.col("first.doc_id").alias(d))
    keyed = docs.withColumn(digest, digest_udf(F.lower(F.col("text")))).withColumn(key, keys.of(F.col(digest)))
    mine = (F.col(key) == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(d))
    once = Window.partitionBy(key, "doc_id").orderBy("doc_id")
    kept = keyed.where(F.col(digest).isNotNull()).join(winners, mine, "left_semi")
    kept = kept.withColumn(rank, F.row_number().over(once)).where(F.col(rank) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionAll(keyed.where(F.col(digest).isNull()).select(*columns))


#: The groups themselves, by comparing every two texts that share a shingle: exact, where signatures may miss a pair.
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, CASE WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' '))) END AS shingles
  FROM w WHERE len(words) > 0),
one AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
root AS (SELECT a AS doc_id, least(a, min(b)) AS duplicate_of FROM reach GROUP BY a)
SELECT doc_id, duplicate_of, group_size FROM (SELECT *, count(*) OVER (PARTITION BY duplicate_of) AS group_size FROM root) WHERE doc_id <> duplicate_of
"""
