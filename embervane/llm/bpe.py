"""Byte-level BPE encoding and decoding, two-tier: a minimal perfect hash for whole pre-tokens, a heap for the rest.

Texts are cut into pre-tokens (contractions, an optional blank with letters, digits or other signs, white space) by numpy
passes over the UTF-8 bytes of an Arrow column. Every pre-token's hash is looked up in a minimal perfect hash of the
vocabulary (hash and displace: one displacement for each bucket, exactly one slot for each entry) and a hit is confirmed
by its bytes. Pre-tokens that are no entry are merged by a heap of adjacent pairs over a linked list of bytes; each
distinct one of a step is merged once, and once for each worker while it stays in a bounded memo. Equal hashes only propose: bytes decide.

The vocabulary is a public rank file (base64 token and rank a line); its path is a parameter and only the driver reads it.

Scale: narrow, no shuffle; the tables (about 2 MB) are broadcast and don't depend on the corpus. A pre-token of any length is
merged in O(n log n).

Defined results: null text gives null ids and null text again, empty text empty ids; a text of any length is encoded whole, in a step of
its own; repeated rows have the same ids, and pairs of equal rank merge from the left; ids unknown to the vocabulary and null ids are an error
when decoded; byte sequences that are no UTF-8 decode with replacement signs; other columns are untouched; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHash, buffers, equal_spans, lean, list_array, mix, small_batches, steps

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO = 150_000
PAIRS = 400_000
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    kinds = {"L": _LETTER, "N": _NUMBER}
    for c in range(sys.maxunicode + 1):
        if kind := kinds.get(unicodedata.category(chr(c))[0]):
            table[c] = kind
    table[_WHITE] = _SPACE
    return table


_table: list[np.ndarray] = []


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of all pre-tokens, and the index of each row's first one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    if not _table:
        _table.append(_classes())
    table = _table[0]
    kind = table[data]  # right for ASCII
    lead = np.flatnonzero(data >= 0xC0)
    follow = (data & 0xC0) == 0x80
    if len(lead):
        b = data[lead].astype(np.int32)
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        code = b & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << 6) | (data[lead[more] + k] & 0x3F)
        kind[lead] = table[code]
        for k in (1, 2, 3):
            at = lead[size > k]
            kind[at + k] = kind[at]
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    begin = row.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begin)  # run starts, and n
    run = run if run[-1] == n else np.append(run, n)
    a, b = run[:-1], run[1:]
    start = begin[:n].copy()
    # white space before something else in its row: its last character stands alone or goes with what follows
    gap = (kind[a] == _SPACE) & ~row[b]
    last = b[gap] - 1
    for _ in range(3):
        last = last - follow[last]
    start[last] = True
    joined = data[last] == 32
    start[b[gap][joined]] = False
    # contractions: a lone apostrophe that starts a pre-token, before letters
    lone = a[(kind[a] == _OTHER) & (b - a == 1) & (data[a] == 39) & ~row[b]]
    lone = lone[start[lone] & (kind[np.minimum(lone + 1, n - 1)] == _LETTER)]
    if len(lone):
        one = data[lone + 1]
        two = np.where((lone + 2 < n) & ~row[np.minimum(lone + 2, n)], data[np.minimum(lone + 2, n - 1)], 0)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((lone[short], 2), (lone[long & ~short], 3)):
            start[at + 1] = False
            after = at + size
            start[after[after < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = sorted(ranks, key=ranks.get)
        self.by_id = {r: t for t, r in ranks.items()}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        lengths = np.array([len(t) for t in self.tokens])
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens) + bytes(8), np.uint8)
        self.ids = np.array([ranks[t] for t in self.tokens], np.int32)
        self.place = np.full(int(self.ids.max()) + 1, -1, np.int64)  # id -> index in tokens
        self.place[self.ids] = np.arange(len(self.ids))
        self.hashes = SpanHash(self.blob).of(self.ends[:-1], self.ends[1:])
        self._build()
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "pairs": {}}

    # -- tier one: minimal perfect hash ------------------------------------------------------------------------
    def _build(self) -> None:
        """Hash and displace: the largest buckets first, each takes the first displacement that hits free slots only.

        A bucket of one entry needs no displacement: it names one of the slots that are left.
        """
        n = len(self.tokens)
        self.buckets = n // 3 + 1
        bucket = (self.hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(sizes) - sizes
        self.shift = np.zeros(self.buckets, np.uint64)
        self.alone = np.full(self.buckets, -1, np.int64)
        self.slot = np.full(n, -1, np.int64)
        tries = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[first[b] : first[b] + sizes[b]]
            base = 0
            while True:
                at = self._displaced(self.hashes[own][None, :], (tries + np.uint64(base))[:, None])
                free = (self.slot[at] < 0).all(1)
                spread = np.sort(at, 1)
                free &= (spread[:, 1:] > spread[:, :-1]).all(1)
                if free.any():
                    break
                base += len(tries)
            k = int(np.argmax(free))
            self.shift[b] = base + k
            self.slot[at[k]] = own
        single = np.flatnonzero(sizes == 1)
        self.alone[single] = np.flatnonzero(self.slot < 0)[: len(single)]
        self.slot[self.alone[single]] = order[first[single]]

    def _displaced(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(len(self.tokens))).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The one slot in which each hash can be."""
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        alone = self.alone[bucket]
        return np.where(alone >= 0, alone, self._displaced(h, self.shift[bucket]))

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Index of the entry that each span is, or -1; ``data`` has 8 bytes to spare at its end."""
        entry = self.slot[self.slots(h)]
        size = end - start
        hit = np.flatnonzero((self.hashes[entry] == h) & (self.ends[entry + 1] - self.ends[entry] == size))
        ours = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        theirs = np.ndarray((len(self.blob) - 7,), "<u8", self.blob, strides=(1,))
        x, y, left, rest = start[hit], self.ends[entry[hit]], size[hit], np.arange(len(hit))
        same = np.ones(len(hit), bool)
        while len(rest):
            spare = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
            same[rest] &= ((ours[x] ^ theirs[y]) << spare) == 0
            go = left > 8
            x, y, left, rest = x[go] + 8, y[go] + 8, left[go] - 8, rest[go]
        found = np.full(len(start), -1, np.int64)
        found[hit[same]] = entry[hit[same]]
        return found

    # -- tier two: heap over linked bytes ----------------------------------------------------------------------
    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank (leftmost among equals) until none is left."""
        node = [self.byte_ids[b] for b in piece]
        n = len(node)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap, known, ask = [], self.pairs.get, self._rank
        for i in range(n - 1):
            left, right = node[i], node[i + 1]
            rank = known(left << 32 | right)
            if rank is None:
                rank = ask(left, right)
            if rank >= 0:
                heap.append((rank, i, left, right))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i, left, right = pop(heap)
            j = after[i]
            if node[i] != left or j >= n or node[j] != right:
                continue  # one of the two has merged since
            node[i], node[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                right = node[k]
                r = known(rank << 32 | right)
                if r is None:
                    r = ask(rank, right)
                if r >= 0:
                    push(heap, (r, i, rank, right))
            h = before[i]
            if h >= 0:
                left = node[h]
                r = known(left << 32 | rank)
                if r is None:
                    r = ask(left, rank)
                if r >= 0:
                    push(heap, (r, h, left, rank))
        return tuple([x for x in node if x >= 0])

    def _rank(self, a: int, b: int) -> int:
        key = a << 32 | b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.by_id[a] + self.by_id[b], -1)
        return rank

    # -- whole columns -----------------------------------------------------------------------------------------
    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row boundaries) of contiguous rows."""
        start, first = pretokens(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), first
        end = np.append(start[1:], len(data))
        data = np.concatenate([data, np.zeros(8, np.uint8)])
        h = SpanHash(data).of(start, end)
        entry = self.lookup(data, start, end, h)
        miss = np.flatnonzero(entry < 0)
        count = np.ones(len(start), np.int64)
        if len(miss):
            one, which = self._distinct(data, start[miss], end[miss], h[miss])
            raw, memo, merged = data.tobytes(), self.memo, []
            for s, e in zip(start[miss[one]].tolist(), end[miss[one]].tolist()):
                piece = raw[s:e]
                ids = memo.get(piece)
                if ids is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    ids = self.merge(piece)
                    if e - s <= 64:
                        memo[piece] = ids
                merged.append(ids)
            sizes = np.array([len(x) for x in merged])
            flat = np.fromiter((i for x in merged for i in x), np.int32, int(sizes.sum()))
            count[miss] = sizes[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(ends[-1], np.int32)
        hit = entry >= 0
        out[ends[:-1][hit]] = self.ids[entry[hit]]
        if len(miss):
            own = sizes[which]
            inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(ends[miss], own) + inside] = flat[np.repeat((np.cumsum(sizes) - sizes)[which], own) + inside]
        return out, ends[first]

    @staticmethod
    def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of one span of each group, group of each span): spans of equal hashes are one group if their bytes are equal."""
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        first, size = one[which], end - start
        same = size[first] == size
        same[same] = equal_spans(data, start[first[same]], start[same], size[same])
        odd = np.flatnonzero(~same)  # a collision: told apart by their bytes
        if len(odd):
            known: dict[tuple[int, bytes], int] = {}
            extra: list[int] = []
            for i in odd.tolist():
                key = int(h[i]), data[start[i] : end[i]].tobytes()
                if key not in known:
                    known[key] = len(one) + len(extra)
                    extra.append(i)
                which[i] = known[key]
            one = np.append(one, extra)
        return one, which

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, row boundaries)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.place) or (self.place[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        entry = self.place[ids]
        size = self.ends[entry + 1] - self.ends[entry]
        at = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.ends[entry] - at[:-1], size)
        source += np.arange(at[-1])
        return self.blob[source], at[ends]


def shared(df: DataFrame, path: str):
    """Broadcast codec of the rank file; each worker unpacks it once and keeps it with its memo."""
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Codec(read_ranks(path)))


def encoder(df: DataFrame, path: str = VOCABULARY):
    """Column function: text -> array<int>."""
    table = shared(df, path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    @lean
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = table.value
        for texts in batches:
            data, offsets = buffers(texts)
            ids, ends, last = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
            for a, b in steps(offsets):
                i, e = own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids.append(i)
                ends.append(e[1:] + last)
                last += len(i)
            yield list_array(pa.array(np.concatenate(ids)), np.concatenate(ends), texts.is_valid().to_numpy(zero_copy_only=False))

    return encode


def decoder(df: DataFrame, path: str = VOCABULARY):
    """Column function: array<int> -> text."""
    table = shared(df, path)

    @F.arrow_udf(T.StringType())
    @lean
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = table.value
        for lists in batches:
            if lists.flatten().null_count:
                raise ValueError("an id is null")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            parts = []
            for a, b in steps(ends):
                parts.append(_texts(*own.decode(ids[ends[a] : ends[b]], ends[a : b + 1] - ends[a])))
            texts = pa.concat_arrays([pa.array([], pa.string()), *parts])
            yield pa.compute.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string())) if lists.null_count else texts

    return decode


def recoder(df: DataFrame, path: str = VOCABULARY):
    """Column function: text -> the text that its ids decode to. The ids stay in one Python function instead of going to the JVM and back."""
    table = shared(df, path)

    @F.arrow_udf(T.StringType())
    @lean
    def recode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = table.value
        for texts in batches:
            data, offsets = buffers(texts)
            parts = [pa.array([], pa.string())]
            for a, b in steps(offsets):
                ids, ends = own.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                parts.append(_texts(*own.decode(ids, ends)))
            back = pa.concat_arrays(parts)
            yield pa.compute.if_else(texts.is_valid(), back, pa.scalar(None, pa.string())) if texts.null_count else back

    return recode


def _texts(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of rows of bytes, with replacement signs where they are no UTF-8."""
    part = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    try:
        return part.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in part.to_pylist()], pa.string())


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, n_tokens, lossless): every text encoded, decoded again and compared."""
    ids = docs.select("doc_id", "text", encoder(docs, path)(F.col("text")).alias("token_ids"))
    back = ids.withColumn("back", decoder(docs, path)(F.col("token_ids")))
    return back.select("doc_id", "token_ids", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), F.col("back").eqNullSafe(F.col("text")).alias("lossless"))
