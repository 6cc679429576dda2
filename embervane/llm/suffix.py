"""Suffix-array dedup: passages of at least ``MIN_WORDS`` words that several documents hold, by a distributed merge sort.

Words are split at ASCII white space. Not every suffix has to be sorted: of each window of ``MIN_WORDS`` words one anchor is
kept, the position whose ``PREFIX``-word hash is lowest in the window (winnowing). Equal windows choose equal anchors,
so two documents that share a passage share an anchor inside it with its left and right context, and nothing is missed.

1. Anchors whose prefix hash occurs in one text only are dropped (hashes alone are shuffled). A hash that is
   shared by chance does no harm.
2. Each task builds the suffixes of its anchors, sorts them, and sends each key range a front-coded run: length of the prefix shared
   with the suffix before, and the rest. Ranges are split at quantiles of the anchors' leading bytes, and leading bytes that fill
   several quantiles once more by a hash of their prefix; there are as many as the bytes of the shared anchors call for.
3. A range's runs are combined by a loser tree whose entries know their common prefix with the last winner: the
   longer one wins unseen, and equal ones are compared from that point on only. The merge gives the sorted suffixes and
   their longest common prefixes (the LCP array).
4. For each of the windows around an anchor, ranks in the suffix order (right context) and in the order of reversed left contexts tell
   exactly which texts hold the same window. Windows held by two documents or more are joined to passages.

Anchors that more than ``HOT_TEXTS`` texts share (a license text in every hundredth document) aren't sorted, as a prefix group is merged
by one task: their windows are digested (128 bits) and grouped with partial sums, which leaves one row a task of a window that all
hold. The texts then look their windows up among the repeated ones: in a broadcast of at most ``BROADCAST_WINDOWS`` of them, by a join beyond.
Hot anchors are found where the texts are read, so no text moves for them, in a broadcast of at most ``BROADCAST_HOT`` of them; beyond,
texts meet them by a join. The result is the same.

Scale: text is shuffled once, for documents with shared anchors; the other shuffles carry hashes and front-coded runs. Texts that
are copies of each other are sorted once. A range holds whole prefix groups of at most ``HOT_TEXTS`` texts each.

Defined results: null, empty and shorter texts have no passages; repeated rows and copies are documents like any other,
so each reports its whole text; a passage twice in one document and nowhere else isn't reported; null doc_ids are
reported as null and are never the first holder; ties (equal suffixes) share their rank, so no order among them matters; words of any
length are compared by all their bytes, texts of any length are searched whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHash, buffers, cut, lean, list_array, mix, once, powers, small_batches, steps, words

MIN_WORDS = 50
PREFIX = 20
#: Ends each word of a suffix; words are split at white space, so none holds it.
END = b" "
RUN_BYTES = 32_000_000
HOT_TEXTS = 20_000
BROADCAST_WINDOWS = 500_000
BROADCAST_HOT = 2_000_000
RANGE_BYTES, ANCHOR_BYTES = 32_000_000, 500
_NO_DOC = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray, min_words: int = MIN_WORDS, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """(hash, word position in its row, leading bytes, row boundaries, words of each row)."""
    start, end, first = words(data, offsets)
    n_words = np.diff(first)
    window = min_words - prefix + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), n_words
    grams = len(start) - prefix + 1
    if grams < window:
        return none
    h = SpanHash(data).of(start, end)
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    h = mix((sums[prefix:] - sums[:-prefix]) * down[:grams])
    # lowest hash of each window, leftmost among equals: high half of the hash, then the position
    low = (h & ~_LOW) | np.arange(grams, dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[: len(low) - (window - size)], low[window - size :])
    row = np.repeat(np.arange(len(n_words)), n_words)
    inside = row[: len(low)] == row[min_words - 1 :][: len(low)]
    at = (low[inside] & _LOW).astype(np.int64)
    if not len(at):
        return none
    at = at[np.append(True, at[1:] != at[:-1])]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lead = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))[start[at]].astype(np.uint64) >> np.uint64(1)
    return h[at], (at - first[row[at]]).astype(np.int32), lead.view(np.int64), np.searchsorted(at, first), n_words


_ANCHORS = T.StructType(
    [T.StructField("n", T.LongType())] + [T.StructField(k, T.ArrayType(t)) for k, t in (("h", T.LongType()), ("at", T.IntegerType()), ("lead", T.LongType()))]
)


def anchor_udf(min_words: int, prefix: int):
    @once
    @F.arrow_udf(_ANCHORS)
    @lean
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = buffers(texts)
            parts = [anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_words, prefix) for a, b in steps(offsets)]
            h, at, lead, ends, n = ([p[k] for p in parts] for k in range(5))
            sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(e) for e in ends]])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            flat = (
                pa.array(np.concatenate([np.zeros(0, np.uint64), *h]).view(np.int64)),
                pa.array(np.concatenate([np.zeros(0, np.int32), *at])),
                pa.array(np.concatenate([np.zeros(0, np.int64), *lead])),
            )
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *n])), *[list_array(x, bounds) for x in flat]], ["n", "h", "at", "lead"]
            )

    return of


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, ``known`` bytes of which need no comparison."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def front_code(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared with the row before, length of the rest, the rests) of sorted rows."""
    shared, before = np.zeros(len(rows), np.int32), b""
    rest = []
    for i, row in enumerate(rows):
        shared[i] = k = common_prefix(before, row)
        rest.append(row[k:])
        before = row
    return shared, np.array([len(r) for r in rest], np.int32), b"".join(rest)


def front_decode(shared: np.ndarray, size: np.ndarray, rest: bytes) -> list[bytes]:
    rows, before, at = [], b"", 0
    for k, n in zip(shared.tolist(), size.tolist()):
        before = before[:k] + rest[at : at + n]
        at += n
        rows.append(before)
    return rows


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs, each with its front-code lengths: ((run, index) in order, common prefix with the one before).

    A loser tree over the runs' heads. ``known[r]`` is the common prefix of r's head with the last winner; a node's loser
    keeps the common prefix with the one that beat it, so no byte of a known prefix is compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    rows = [r[0] for r in runs] + [[] for _ in range(k - len(runs))]
    codes = [r[1] for r in runs] + [[] for _ in range(k - len(runs))]
    place = [0] * k
    head: list[bytes] = [r[0] if r else b"" for r in rows]
    known = [0 if r else -1 for r in rows]  # -1: the run is used up
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = head[a], head[b]
        both = common_prefix(p, q, x)
        if p[both : both + 1] <= q[both : both + 1]:  # an ended row is the lower one
            known[b] = both
            return a, b
        known[a] = both
        return b, a

    level = list(range(k))
    base = k
    while len(level) > 1:
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            win, lose = play(level[i], level[i + 1])
            loser[base + i // 2] = lose
            up.append(win)
        level = up
    winner = level[0]
    order, lcp = [], []
    while known[winner] >= 0:
        i = place[winner]
        order.append((winner, i))
        lcp.append(known[winner])
        i += 1
        place[winner] = i
        own = rows[winner]
        if i < len(own):
            head[winner], known[winner] = own[i], codes[winner][i]
        else:
            known[winner] = -1
        node = (winner + k) // 2
        while node:
            other = loser[node]
            x, y = known[winner], known[other]
            if x < y:
                loser[node], winner = winner, other
            elif x == y and x >= 0:
                winner, loser[node] = play(winner, other)
            node //= 2
    return order, lcp


@lean
def runs_of(batches: Iterator[pa.RecordBatch], marks: np.ndarray, min_words: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Front-coded sorted runs, one for each key range, of the suffixes at the given anchors."""
    left_words, splits = min_words - prefix, np.unique(marks, return_counts=True)
    rows: list[tuple[bytes, bytes, int, int, int]] = []
    held = 0
    for batch in batches:
        for key, doc, text, at in zip(batch["key"].to_pylist(), batch["doc"].to_pylist(), batch["text"], batch["at"]):
            split = text.as_buffer().to_pybytes().split()
            for p in at.values.to_pylist():
                right = END.join(split[p : p + min_words]) + END
                left = END.join(split[max(0, p - left_words) : p][::-1]) + END if p else b""
                rows.append((right, left, key, p, doc))
                held += len(right) + len(left) + 150
            if held > RUN_BYTES:
                yield from _ranged(rows, *splits, prefix)
                rows, held = [], 0
    if rows:
        yield from _ranged(rows, *splits, prefix)


def _ranged(rows: list[tuple[bytes, bytes, int, int, int]], splits: np.ndarray, repeats: np.ndarray, prefix: int) -> Iterator[pa.RecordBatch]:
    rows.sort()
    lead = np.array([int.from_bytes(r[0][:8].ljust(8, b"\0")) >> 1 for r in rows], np.int64)
    part = np.searchsorted(splits, lead, side="right")
    if len(splits):
        # leading bytes that are several quantiles: as many parts, by prefix
        begin = np.maximum(part - 1, 0)
        parts = np.concatenate([[1], repeats])[part]
        part = np.concatenate([[0], np.cumsum(repeats)])[part]
        for i in np.flatnonzero((parts > 1) & (splits[begin] == lead)).tolist():
            part[i] -= xxhash.xxh3_64_intdigest(END.join(rows[i][0].split(END, prefix)[:prefix])) % int(parts[i])
    for r in np.unique(part):
        own = [rows[i] for i in np.flatnonzero(part == r)]
        shared, size, rest = front_code([x[0] for x in own])
        columns = {
            "range": [int(r)],
            "shared": [shared.tobytes()],
            "size": [size.tobytes()],
            "rest": [rest],
            "left_size": [np.array([len(x[1]) for x in own], np.int32).tobytes()],
            "left": [b"".join(x[1] for x in own)],
            "key": [np.array([x[2] for x in own], np.int64).tobytes()],
            "at": [np.array([x[3] for x in own], np.int32).tobytes()],
            "doc": [np.array([x[4] for x in own], np.int64).tobytes()],
        }
        yield pa.RecordBatch.from_pydict(columns, schema=_RUN_ARROW)


def at_hot(batches: Iterator[pa.RecordBatch], known, min_words: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """The rows (key, doc, text) with anchors among the known hashes, and where these are (at)."""
    hashes = known.value
    for batch in batches:
        data, offsets = buffers(batch["text"])
        for a, b in steps(offsets):
            h, at, _, ends, _ = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_words, prefix)
            own = h.view(np.int64)
            hot = hashes[np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)] == own
            bounds = np.concatenate([[0], np.cumsum(hot)])[ends]
            some = pa.array(np.flatnonzero(np.diff(bounds)))
            if len(some):
                rows = batch.slice(a, b - a).take(some)
                yield pa.RecordBatch.from_arrays([rows["key"], rows["doc"], rows["text"], list_array(pa.array(at[hot]), bounds).take(some)], ["key", "doc", "text", "at"])


_WINDOWS = "digest binary, key long, start int, doc long"


def _windows(batch: pa.RecordBatch, min_words: int, prefix: int) -> Iterator[tuple[int, int, np.ndarray, list[bytes]]]:
    """(key, doc, first words, digests) of each text: its windows that hold the prefix of one of the given anchors."""
    digest = xxhash.xxh3_128_digest
    for key, doc, text, at in zip(batch["key"].to_pylist(), batch["doc"].to_pylist(), batch["text"], batch["at"]):
        split = text.as_buffer().to_pybytes().split()
        starts = sorted({x for p in at.values.to_pylist() for x in range(max(0, p - min_words + prefix), min(p, len(split) - min_words) + 1)})
        yield key, doc, np.array(starts, np.int64), [digest(END.join(split[x : x + min_words])) for x in starts]


@lean
def windows_of(batches: Iterator[pa.RecordBatch], min_words: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Digest, text and first word of every window that holds one of the given anchors' prefixes."""
    for batch in batches:
        for key, doc, starts, digests in _windows(batch, min_words, prefix):
            n = len(starts)
            columns = {"digest": digests, "key": np.full(n, key, np.int64), "start": starts.astype(np.int32), "doc": np.full(n, doc, np.int64)}
            yield pa.RecordBatch.from_pydict(columns, schema=_WINDOWS_ARROW)


class Repeated:
    """Repeated windows' digests as two sorted arrays, with the lowest doc of each."""

    def __init__(self, digests: list[bytes], first: np.ndarray):
        halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.high, self.low, self.first = halves[order, 0], halves[order, 1], first[order]

    def find(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(which are repeated, the lowest doc of each of these)."""
        halves = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
        at, hit = np.searchsorted(self.high, halves[:, 0]), np.full(len(halves), -1, np.int64)
        open_ = np.flatnonzero(at < len(self.high))
        while len(open_):  # digests of one high half stand side by side
            open_ = open_[self.high[at[open_]] == halves[open_, 0]]
            same = self.low[at[open_]] == halves[open_, 1]
            hit[open_[same]] = at[open_[same]]
            at[open_] += 1
            open_ = open_[~same & (at[open_] < len(self.high))]
        some = np.flatnonzero(hit >= 0)
        return some, self.first[hit[some]]


@lean
def spans_of(batches: Iterator[pa.RecordBatch], shared, min_words: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Key, start, end and lowest doc of every stretch of repeated windows."""
    for batch in batches:
        rows: list[tuple[int, int, int, int]] = []
        for key, _, starts, digests in _windows(batch, min_words, prefix):
            if digests:
                some, first = shared.value.find(digests)
                hit = starts[some]
                begin = np.flatnonzero(np.append(True, np.diff(hit) > min_words)) if len(hit) else hit
                for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(hit)]):
                    rows.append((key, int(hit[a]), int(hit[b - 1]) + min_words, int(first[a:b].min())))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "start", "end", "first"])


_WINDOWS_ARROW = pa.schema([("digest", pa.binary()), ("key", pa.int64()), ("start", pa.int32()), ("doc", pa.int64())])
_RUN = "range int, shared binary, size binary, rest binary, left_size binary, left binary, key binary, at binary, doc binary"
_RUN_ARROW = pa.schema([("range", pa.int32())] + [(k, pa.binary()) for k in ("shared", "size", "rest", "left_size", "left", "key", "at", "doc")])
_SPANS = "key long, start int, end int, first long"


def merged_range(table: pa.Table, min_words: int, prefix: int) -> pa.Table:
    """(key, start, end, first): for each anchor the words covered by its windows that another text holds too."""
    runs, lefts, columns = [], [], []
    for row in table.to_pylist():
        shared = np.frombuffer(row["shared"], np.int32)
        runs.append((front_decode(shared, np.frombuffer(row["size"], np.int32), row["rest"]), shared.tolist()))
        ends = np.cumsum(np.frombuffer(row["left_size"], np.int32)).tolist()
        lefts.append([row["left"][a:b] for a, b in zip([0, *ends], ends)])
        columns.append([np.frombuffer(row[k], t) for k, t in (("key", np.int64), ("at", np.int32), ("doc", np.int64))])
    order, lcp = merge_runs(runs)
    base = np.cumsum([0, *[len(r[0]) for r in runs]])
    index = np.array([base[r] + i for r, i in order], np.int64)
    right_lcp = np.array([runs[r][0][i].count(END, 0, k) for (r, i), k in zip(order, lcp)], np.int64)
    # prefix groups of one anchor are done with
    alone = right_lcp < prefix
    near = ~alone
    near[:-1] |= ~alone[1:]
    keep = np.flatnonzero(near)
    if not len(keep):
        return pa.table({"key": pa.array([], pa.int64()), "start": pa.array([], pa.int32()), "end": pa.array([], pa.int32()), "first": pa.array([], pa.int64())})
    right_words = np.array([runs[r][0][i].count(END) for r, i in (order[j] for j in keep)])
    left = [lefts[order[j][0]][order[j][1]] for j in keep]
    key, at, doc = (np.concatenate([c[k] for c in columns])[index[keep]] for k in range(3))
    # dropping lone suffixes keeps the prefixes of the others: a lone one shares less than ``prefix`` words with both sides
    right_lcp = right_lcp[keep]
    by_left = sorted(range(len(left)), key=left.__getitem__)
    left_lcp, before = np.zeros(len(left), np.int64), b""
    for j, i in enumerate(by_left):
        left_lcp[j] = before.count(END, 0, common_prefix(before, left[i]))
        before = left[i]
    left_words = np.array([x.count(END) for x in left])
    by_left = np.array(by_left)
    n = len(keep)
    most, least, first = np.full(n, -1, np.int64), np.full(n, min_words, np.int64), np.full(n, _NO_DOC, np.int64)
    for o in range(min_words - prefix + 1):
        right_rank = np.cumsum(right_lcp < min_words - o)
        left_rank = np.empty(n, np.int64)
        left_rank[by_left] = np.cumsum(left_lcp < o)
        ok = np.flatnonzero((right_words >= min_words - o) & (left_words >= o))
        if len(ok) < 2:
            continue
        both = right_rank[ok] * (n + 1) + left_rank[ok]
        group = np.argsort(both, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(both[group]) != 0))
        ids = key[ok][group]
        several = np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)
        lowest = np.minimum.reduceat(doc[ok][group], begin)
        size = np.diff(np.append(begin, len(group)))
        hit = np.repeat(several, size)
        who = ok[group[hit]]
        most[who] = o
        least[who] = np.minimum(least[who], o)
        first[who] = np.minimum(first[who], np.repeat(lowest, size)[hit])
    hit = np.flatnonzero(most >= 0)
    return pa.table(
        {
            "key": pa.array(key[hit]),
            "start": pa.array((at[hit] - most[hit]).astype(np.int32)),
            "end": pa.array((at[hit] - least[hit] + min_words).astype(np.int32)),
            "first": pa.array(first[hit]),
        }
    )


def text_keys(rows: DataFrame, bits: int = 64) -> Column:
    """A bigint for each digest: a hash of ``bits`` bits, and another one where several digests share it (of n about n * n / 2**65 do)."""
    digest = F.col("digest")
    key = F.xxhash64(digest) if bits == 64 else F.xxhash64(digest).bitwiseAND(F.lit((1 << bits) - 1))
    shared = rows.groupBy(key.alias("key")).agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low < high")
    known = [r.key for r in shared.select("key").toLocalIterator()]
    return F.when(key.isin(known), F.xxhash64(F.lit("again"), digest)).otherwise(key) if known else key


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, prefix: int = PREFIX, bits: int = 64, hot_texts: int = HOT_TEXTS, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_hot: int = BROADCAST_HOT) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): passages (end exclusive) that at least two documents hold.

    ``first_doc_id`` is the lowest doc_id that holds some window of the passage; dedup keeps it there and drops it elsewhere.
    """
    if not 1 <= prefix < min_words:
        raise ValueError("prefix must be at least 1 and less than min_words")
    session = docs.sparkSession
    small_batches(session)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    rows = texts.select("doc_id", "digest", anchor_udf(min_words, prefix)(F.col("text")).alias("a"))
    rows = cut(rows.select("doc_id", "digest", "a.n", "a.h", "a.at", "a.lead").where(F.col("n") >= min_words))
    key = text_keys(rows, bits)
    rows, texts = rows.withColumn("key", key), texts.withColumn("key", key)
    texts_of = rows.groupBy("key").agg(F.coalesce(F.min("doc_id"), F.lit(_NO_DOC)).alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    texts_of = cut(texts_of)
    # 1: anchors that two texts share
    every = rows.select("key", F.explode(F.arrays_zip("h", "at")).alias("a")).select("key", "a.h", "a.at")
    shared = every.groupBy("h").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y")
    shared = cut(shared.select("h", "n"))
    hot = F.col("n") > hot_texts
    size = shared.agg(F.sum(F.when(~hot, F.col("n"))), F.sum(hot.cast("long"))).first()
    ranges = max(2 * int(session.conf.get("spark.sql.shuffle.partitions")), (size[0] or 0) * ANCHOR_BYTES // RANGE_BYTES)
    marks = rows.select(F.explode("lead").alias("lead")).agg(F.percentile_approx("lead", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    marks = np.array(marks or [], np.int64)

    def texts_at(anchor: DataFrame) -> DataFrame:
        mine = every.join(anchor.select("h"), "h", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("at"))
        mine = mine.join(texts_of.select("key", "doc"), "key")
        return texts.select("key", "text").join(mine, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("doc", "text", "at")])

    # 2 to 4
    runs = texts_at(shared.where(~hot)).mapInArrow(lambda it: runs_of(it, marks, min_words, prefix), _RUN)

    def merge(table: pa.Table) -> pa.Table:
        return merged_range(table, min_words, prefix)

    spans = runs.groupBy("range").applyInArrow(merge, _SPANS)
    if size[1]:
        if size[1] <= broadcast_hot:
            hashes = session.sparkContext.broadcast(np.sort(shared.where(hot).select("h").toArrow()["h"].to_numpy()))
            own = texts.select("key", F.coalesce("doc_id", F.lit(_NO_DOC)).alias("doc"), "text")
            own = own.mapInArrow(lambda it: at_hot(it, hashes, min_words, prefix), "key long, doc long, text string, at array<int>")
        else:
            own = cut(texts_at(shared.where(hot)))
        found = own.mapInArrow(lambda it: windows_of(it, min_words, prefix), _WINDOWS)
        groups = found.groupBy("digest").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.min("doc").alias("first")).where("x < y")
        groups = cut(groups.select("digest", "first"))
        if groups.count() <= broadcast_windows:
            table = groups.toArrow()
            known = session.sparkContext.broadcast(Repeated(table["digest"].to_pylist(), table["first"].to_numpy()))
            more = own.mapInArrow(lambda it: spans_of(it, known, min_words, prefix), _SPANS)
        else:
            more = found.join(groups, "digest").select("key", "start", (F.col("start") + min_words).cast("int").alias("end"), "first")
        spans = spans.unionAll(more.distinct())  # copies give the same
    copies = texts_of.where("copies > 1").select("key", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"), F.col("doc").alias("first"))
    # overlapping and touching spans of a text are one passage
    by = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.unionAll(copies).withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    passages = islands.groupBy("key", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("first").alias("first"))
    found = rows.select("doc_id", "key").join(passages, "key")
    return found.select("doc_id", "start_word", "end_word", F.when(F.col("first") < _NO_DOC, F.col("first")).alias("first_doc_id"))


SQL = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + {MIN_WORDS - 1}], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {MIN_WORDS - 2})) AS i FROM w WHERE len(words) >= {MIN_WORDS})),
shared AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, i - 1 AS s, i - 1 + {MIN_WORDS} AS e, first FROM windows JOIN shared USING (h)),
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hits),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(e) AS INTEGER) AS end_word, min(first) AS first_doc_id
FROM islands GROUP BY doc_id, island
"""
