"""Line dedup: lines that very many documents share are dropped.

Lines are normalised (outer white space off, inner white space folded, lower case), hashed inside the JVM, exploded,
and counted over distinct documents, where exact copies of one text are one document. A line of more than
``MIN_DOCS`` documents, however large the table is, goes from every row but those of the lowest ``doc_id`` that holds it, so no
passage leaves the corpus altogether (``keep_first=False`` drops it there too). The text is put together again from the
kept lines, by position. Blank lines are never counted or dropped.

Scale: only 64-bit hashes are shuffled, never text; counts are over distinct pairs, folded before the shuffle. A common line needs
over ``MIN_DOCS`` distinct texts, so the list of them is a small part of the lines; its length is checked, and past
``broadcast_rows`` the same rule runs as a shuffled join. A text is cut and joined in one pass, whatever the number of its lines.

Defined results: null text stays null, empty text stays empty; texts of any length are read whole; a row with null ``doc_id`` loses
common lines but has no vote and is never the first holder; repeated rows count once and are treated alike; a line in exactly
``MIN_DOCS`` documents stays; an empty table gives an empty table; all other columns pass unchanged, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, once, small_batches

MIN_DOCS = 100
BROADCAST_ROWS = 2_000_000


def line_hashes(text: Column) -> Column:
    """array<bigint>: hash of each normalised line; null for blank lines."""

    def one(line: Column) -> Column:
        clean = F.lower(F.trim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")))
        return F.when(clean != "", F.xxhash64(clean))

    return F.transform(F.split(text, "\n"), one)


def common_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """(hash, first): lines of more than ``min_docs`` distinct documents and the lowest doc_id that holds them."""
    seen = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.explode(F.array_distinct(line_hashes(F.col("text")))).alias("h")
    )
    # copies fold before the shuffle, and the count over (line, text) pairs is of two steps, so a hot line is no single group
    once = seen.where("h is not null").groupBy("h", "t").agg(F.min("d").alias("d"))
    return once.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first")).where(F.col("n") > min_docs).select("h", "first")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_rows: int = BROADCAST_ROWS, keep_first: bool = True) -> DataFrame:
    """``docs`` with the same columns and rows, and ``text`` without lines over the threshold."""
    small_batches(docs.sparkSession)
    flagged = common_lines(docs, min_docs)
    if not keep_first:
        flagged = flagged.withColumn("first", F.lit(None).cast("long"))
    rows = flagged.limit(broadcast_rows + 1).toArrow()
    if rows.num_rows > broadcast_rows:
        return _joined(docs, flagged)
    if not rows.num_rows:
        return docs
    h = rows["h"].to_numpy()
    order = np.argsort(h)
    held = rows["first"].is_valid().to_numpy(zero_copy_only=False)[order]
    shared = docs.sparkSession.sparkContext.broadcast((h[order], rows["first"].fill_null(0).to_numpy()[order], held))

    @once
    @F.arrow_udf("string")
    @lean
    def without(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts, hashes in batches:
            yield _without(ids, texts, hashes, *shared.value)

    (left,) = fresh(docs, "left")
    marked = docs.withColumn(left, without(F.col("doc_id"), F.col("text"), line_hashes(F.col("text"))))
    return marked.withColumn("text", F.coalesce(left, "text")).drop(left)


def _without(ids: pa.Array, texts: pa.Array, hashes: pa.Array, h: np.ndarray, first: np.ndarray, held: np.ndarray) -> pa.Array:
    """The text of each row without its common lines; null where nothing goes."""
    sizes = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    flat = hashes.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    value = flat.fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(h, value), len(h) - 1)
    hit = np.flatnonzero(known & (h[at] == value))
    row = np.searchsorted(ends, hit, side="right") - 1
    own = ids.fill_null(0).to_numpy(zero_copy_only=False)[row]
    named = ids.is_valid().to_numpy(zero_copy_only=False)[row]
    hit, row = (x[~(named & held[at[hit]] & (own == first[at[hit]]))] for x in (hit, row))
    out: list[str | None] = [None] * len(ids)
    bounds = np.flatnonzero(np.append(True, np.diff(row) != 0)) if len(row) else np.zeros(0, np.int64)
    for r, gone in zip(row[bounds].tolist(), np.split(hit - ends[row], bounds[1:])):
        kept = np.ones(sizes[r], bool)
        kept[gone] = False
        out[r] = "\n".join(compress(texts[r].as_py().split("\n"), kept.tolist()))
    return pa.array(out, pa.string())


def _joined(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """The same by a shuffled join: rows get a number, lines are exploded, marked, and collected by position."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), F.col("text"), F.col("doc_id").alias("d"), F.monotonically_increasing_id().alias("row"))
    zipped = F.arrays_zip(F.split("text", "\n").alias("s"), line_hashes(F.col("text")).alias("h"))
    lines = rows.select("*", F.posexplode_outer(zipped).alias("pos", "line")).drop("text")
    marked = lines.join(flagged.withColumn("common", F.lit(True)), F.col("line.h") == F.col("h"), "left")
    drop = F.col("common").isNotNull() & (F.col("first").isNull() | F.col("d").isNull() | (F.col("d") != F.col("first")))
    back = marked.groupBy("row").agg(
        F.first("rest").alias("rest"),
        F.max(F.col("line").isNotNull()).alias("any"),
        F.array_sort(F.collect_list(F.when(~drop & F.col("line").isNotNull(), F.struct("pos", F.col("line.s").alias("s"))))).alias("kept"),
    )
    text = F.when(F.col("any"), F.array_join(F.col("kept.s"), "\n"))
    return back.select(*[(text if c == "text" else F.col("rest").getField(c)).alias(c) for c in docs.columns])


SQL = """
WITH lines AS (
  SELECT doc_id, md5(text) AS t, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
norm AS (SELECT *, lower(trim(regexp_replace(line, '[ \t\r\f\v]+', ' ', 'g'))) AS key FROM lines),
common AS (
  SELECT key, min(doc_id) AS first FROM norm WHERE key <> '' GROUP BY key
  HAVING count(DISTINCT t) > {docs}),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM norm LEFT JOIN common USING (key)
  WHERE common.first IS NULL OR common.first = doc_id GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def sql(min_docs: int = MIN_DOCS) -> str:
    return SQL.replace("{docs}", str(min_docs))
