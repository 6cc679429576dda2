"""Shared pieces of the corpus operators: byte-wise numpy hashing of Arrow strings and lineage cuts.

Nothing here is text-model specific; every helper works on whole columns (Arrow buffers), never per row.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles; temporaries are about 60 times as large. A longer
#: document forms a step of its own.
STEP_BYTES = 400_000

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by an eager checkpoint.

    Files go to the folder that ``spark.checkpoint.dir`` names (all executors share it, so a lost executor
    loses nothing). Only where the session has no such setting, as in tests, is a temporary folder used.
    """
    session = df.sparkSession
    ensure_checkpoint_dir(session)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(session: SparkSession) -> None:
    """On a cluster the setting has to be there: a folder of the driver's machine would be no shared one."""
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        named = session.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="embervane-checkpoint-"))


def small_batches(session: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows in this session, as texts are large rows; a setting of the session's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in session.conf.getAll and session.sparkContext.getConf().get(name) is None:
        session.conf.set(name, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own += "_"
        taken.add(own.lower())
        out.append(own)
    return out


def lean(batches: Callable) -> Callable:
    """A generator function that gives freed memory back when it ends, as Python workers live on between stages."""

    @wraps(batches)
    def run(*args):
        try:
            yield from batches(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    return run


def once(udf):
    """The function, run once: filters on its result aren't pushed through it, which would run it a second time."""
    return udf.asNondeterministic()


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche finaliser on uint64 (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * STEP_BYTES + 65_536)
        grown = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            grown.append(p)
        if n > 4 * STEP_BYTES:  # not worth keeping
            return grown[0][:n], grown[1][:n]
        _powers[:] = grown
    return _powers[0][:n], _powers[1][:n]


#: A polynomial modulo 2**64 has known collisions between spans of 1,024 bytes and more; past this length XXH3 is used.
LONG_SPAN = 128


class SpanHash:
    """Hashes of arbitrary spans of a byte buffer: polynomials in O(1) each, XXH3 for the few that are long."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(self.up[: len(data)], data, out=self.sums[1:], casting="unsafe")
        self.sums[1:] += self.up[: len(data)]
        np.cumsum(self.sums[1:], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = mix((self.sums[end] - self.sums[start]) * self.down[start])
        long = np.flatnonzero(end - start > LONG_SPAN)
        if len(long):
            raw = memoryview(np.ascontiguousarray(self.data))
            h[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())]
        return h

    def sliding(self, n: int) -> np.ndarray:
        """Unmixed hashes of all spans of ``n`` bytes, by start."""
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        h = self.sums[n:] - self.sums[:-n]
        h *= self.down[: len(h)]
        return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of an Arrow string column; a null is an empty span."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``limit`` bytes; one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def spaces(data: np.ndarray) -> np.ndarray:
    """True at ASCII white space."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every white-space separated word, and the index of the first word of each row.

    Rows are contiguous in ``data``; a row's end ends a word.
    """
    n = len(data)
    if blank is None:
        blank = spaces(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(blank, out=inside[:n])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins[:n])
    # an inside byte whose successor is blank, the buffer's end or another row's first byte
    last = inside[:n] & ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def equal_spans(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes at ``x`` and at ``y`` are equal; ``data`` has 8 bytes to spare at its end."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    same, rest, left = np.ones(len(x), bool), np.arange(len(x)), size
    while len(rest):
        spare = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
        same[rest] &= ((eight[x] ^ eight[y]) << spare) == 0
        go = (left > 8) & same[rest]
        x, y, left, rest = x[go] + 8, y[go] + 8, left[go] - 8, rest[go]
    return same


def list_array(values: pa.Array, ends: np.ndarray, valid: np.ndarray | None = None) -> pa.ListArray:
    """Arrow list column from flat values and row boundaries (len rows + 1)."""
    offsets = pa.array(ends.astype(np.int32))
    if valid is not None and not valid.all():
        return pa.ListArray.from_arrays(offsets, values, mask=pa.array(~valid))
    return pa.ListArray.from_arrays(offsets, values)
