"""Document fingerprints: exact duplicates by a canonical 128-bit digest, confirmed byte by byte.

Canonical form: Unicode NFKC, full case folding, NFKC again, white-space runs folded to one space, ends trimmed. The digest is
the 128-bit xxHash of its UTF-8 bytes.

1. Digests are counted, with the lowest (doc_id, row) of each; partial sums come first, so a digest of a third of all rows is one
   row of each task.
2. The canonical bytes of repeated digests, and of hardly any others (a filter of bits, of ``FILTER_BITS`` at most, tells them
   apart before anything is shuffled), are grouped with their digest; again each text leaves a task once. A digest with two
   different texts is a collision.
3. Rows meet the counts of their digest; rows of collided digests, if there ever are any, meet by their bytes instead.

Scale: what is shuffled is a digest and an id a row, and each repeated text once from each task that holds it; unique texts stay where
they are. The join in 3 is one to many, so a hot digest can be split (adaptive skew join).

Defined results: null text has no fingerprint, is a group of its own and is kept; empty and blank texts share the empty
canonical form; texts of any length are read and compared whole; repeated rows count as copies; ties on ``doc_id`` are broken so exactly
one row is kept; ``group_id`` is the lowest doc_id (null only if all are null); further columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, once, small_batches

FILTER_BITS = 1 << 28
PROBES = 3
_RUNS = re.compile(r"\s+")


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    nfkc = unicodedata.normalize
    return " ".join(nfkc("NFKC", nfkc("NFKC", text).casefold()).split())


def probes(digests: list[bytes], bits: int) -> np.ndarray:
    """``PROBES`` places in a filter of ``bits`` bits for each digest."""
    halves = np.frombuffer(b"".join(d[:16].ljust(16, b"\0") for d in digests), np.uint64).reshape(-1, 2)
    places = halves[:, :1] + halves[:, 1:] * np.arange(PROBES, dtype=np.uint64)
    return (places % np.uint64(bits)).astype(np.int64)


def canonical_digest(digest: Callable[[bytes], bytes], shared=None):
    """Column function: text -> (digest, canonical bytes); bytes only of digests in the filter, and none without a filter."""

    @once
    @F.arrow_udf(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("canon", T.BinaryType())]))
    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = shared.value if shared is not None else None
        for texts in batches:
            canon = [None if t is None else canonical(t).encode() for t in texts.to_pylist()]
            found = [None if c is None else digest(c) for c in canon]
            if words is None:
                canon = [None] * len(canon)
            else:
                some = [i for i, d in enumerate(found) if d is not None]
                at = probes([found[i] for i in some], 64 * len(words))
                hit = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)
                known = {i for i, h in zip(some, hit.tolist()) if h}
                canon = [c if i in known else None for i, c in enumerate(canon)]
            yield pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(canon, pa.binary())], ["digest", "canon"])

    return run


def filter_words(digests: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """The filter of a table of digests, 16 bits or more for each up to ``most_bits`` in all, as 64-bit words."""
    bits = 1 << min(most_bits.bit_length() - 1, max(10, (16 * digests.count()).bit_length()))

    @F.arrow_udf("array<long>")
    def places(batch: pa.Array) -> pa.Array:
        return pa.array(list(probes(batch.to_pylist(), bits)), pa.list_(pa.int64()))

    at = digests.select(F.explode(places(F.col("digest"))).alias("at"))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    rows = at.select(F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint64)


def fingerprints(docs: DataFrame, digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest) -> DataFrame:
    """(doc_id, fingerprint, group_id, copies, keep), one row for each input row."""
    small_batches(docs.sparkSession)
    one = docs.select("doc_id", canonical_digest(digest)(F.col("text")).alias("f")).select("doc_id", F.col("f.digest").alias("digest"))
    rows = cut(one.withColumn("row", F.monotonically_increasing_id()))
    repeated = cut(_groups(rows, "digest").where("copies > 1"))
    words = docs.sparkSession.sparkContext.broadcast(filter_words(repeated))
    whole = canonical_digest(digest, words)
    texts = docs.select(whole(F.col("text")).alias("f")).where("f.canon is not null").groupBy("f.digest", "f.canon").agg(F.count(F.lit(1)).alias("n"))
    several = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    collided = [bytes(r.digest) for r in several.toLocalIterator()]  # expected: none
    if not collided:
        return _numbered(rows, repeated, "digest")
    odd = F.col("digest").isin(collided)
    apart = docs.select("doc_id", whole(F.col("text")).alias("f")).select("doc_id", F.col("f.digest").alias("digest"), F.col("f.canon").alias("canon"))
    apart = cut(apart.where(odd).withColumn("row", F.monotonically_increasing_id()))
    plain = _numbered(rows.where(F.col("digest").isNull() | ~odd), repeated, "digest")
    return plain.unionByName(_numbered(apart, _groups(apart, "canon").where("copies > 1"), "canon"))


def _groups(rows: DataFrame, by: str) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("copies"), first)


def _numbered(rows: DataFrame, repeated: DataFrame, by: str) -> DataFrame:
    found = rows.join(repeated, by, "left")
    return found.select(
        "doc_id",
        F.lower(F.hex("digest")).alias("fingerprint"),
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("group_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("row"))).alias("keep"),
    )


#: The grouping, for texts whose compatibility forms and case folds DuckDB shares (lower = fold, NFC = NFKC).
GROUPS_SQL = r"""
WITH c AS (
  SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(text)), '\s+', ' ', 'g')) AS canon FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY canon) AS group_id,
       CAST(count(*) OVER (PARTITION BY canon) AS BIGINT) AS copies,
       row_number() OVER (PARTITION BY canon ORDER BY doc_id) = 1 AS keep
FROM c
"""
