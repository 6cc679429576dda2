"""Vector functions on array columns. All work in double precision and stay inside the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let

EPS = 1e-12
GELU_SCALE, GELU_CUBE = 0.7978846, 0.044715


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)


def scale(v: Column, c: float) -> Column:
    return F.transform(doubles(v), lambda x: x * F.lit(float(c)))


def shift(v: Column, c: float) -> Column:
    return F.transform(doubles(v), lambda x: x + F.lit(float(c)))


def total(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(mul(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    """The vector over its length; a zero vector stays zero."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda length: F.transform(doubles(v), lambda x: x / length))


def softmax(v: Column) -> Column:
    """Shifted by the maximum; an empty vector gives null."""

    def over(powers: Column) -> Column:
        whole = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
        return let(whole, lambda w: F.transform(powers, lambda x: x / w))

    shifted = let(F.array_max(doubles(v)), lambda top: F.transform(doubles(v), lambda x: F.exp(x - top)))
    return F.when(F.size(v) > 0, let(shifted, over))


def layer_norm(v: Column, gamma: Column | None = None, beta: Column | None = None, eps: float = EPS) -> Column:
    """(v - mean) / sqrt(population variance + eps), then gamma and beta by element."""
    n = F.size(v)

    def over(centred: Column) -> Column:
        variance = F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x) / n
        return let(F.sqrt(variance + F.lit(eps)), lambda d: F.transform(centred, lambda x: x / d))

    out = let(let(total(v) / n, lambda mean: F.transform(doubles(v), lambda x: x - mean)), over)
    out = mul(out, gamma) if gamma is not None else out
    return F.when(n > 0, add(out, beta) if beta is not None else out)


def gelu(v: Column) -> Column:
    """The tanh form."""
    return F.transform(doubles(v), lambda x: 0.5 * x * (1 + F.tanh(GELU_SCALE * (x + GELU_CUBE * x * x * x))))


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    """Dot over the product of lengths, the product at least ``eps``; a NaN product counts as ``eps``."""
    length = norm(a) * norm(b)
    return dot(a, b) / F.greatest(F.nanvl(length, F.lit(eps)), F.lit(eps))


def f16_decode(code: Column) -> Column:
    """The double that a 16-bit IEEE half (as an integer) stands for."""
    sign = F.when(code.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
    power, part = F.shiftright(code, 10).bitwiseAND(F.lit(0x1F)), code.bitwiseAND(F.lit(0x3FF))
    return (
        F.when(power == 0, sign * part * 2.0**-24)
        .when(power < 31, sign * F.pow(F.lit(2.0), power - 25) * (part + 1024))
        .when(part == 0, sign * float("inf"))
        .otherwise(F.lit(float("nan")))
    )


def bf16_decode(code: Column) -> Column:
    """The double that a 16-bit brain float (as an integer) stands for."""
    sign = F.when(code.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
    power, part = F.shiftright(code, 7).bitwiseAND(F.lit(0xFF)), code.bitwiseAND(F.lit(0x7F))
    return (
        F.when(power == 0, sign * part * 2.0**-133)
        .when(power < 255, sign * F.pow(F.lit(2.0), power - 134) * (part + 128))
        .when(part == 0, sign * float("inf"))
        .otherwise(F.lit(float("nan")))
    )


@F.arrow_udf(T.BinaryType())
def to_blob(vectors: pa.Array) -> pa.Array:
    """Little-endian float32 bytes of each vector; a null element is NaN."""
    flat = vectors.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = 4 * np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat, "<f4"))])
    return pa.compute.if_else(vectors.is_valid(), raw.cast(pa.binary()), pa.scalar(None, pa.binary()))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pa.Array) -> pa.Array:
    """The vectors of ``to_blob``; a length that is no multiple of 4 is an error."""
    sizes = pa.compute.binary_length(blobs).fill_null(0).to_numpy(zero_copy_only=False)
    if (odd := sizes[sizes % 4 != 0]).size:
        raise ValueError(f"a vector blob has {odd[0]} bytes, no multiple of 4")
    whole = blobs.fill_null(b"") if blobs.null_count else blobs
    _, offsets, data = whole.buffers()
    begin = np.frombuffer(offsets, np.int32)[whole.offset] if len(whole) else 0
    flat = np.frombuffer(data, np.uint8)[begin : begin + sizes.sum()].copy().view("<f4") if data is not None else np.zeros(0, "<f4")
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes // 4)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(flat), mask=blobs.is_null() if blobs.null_count else None)
