"""Safetensors files: 8 bytes of header length, a JSON header, raw little-endian tensors. Reader, writer and a table view."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import ModelError, SourceError, TensorError


def to_bfloat16(values: np.ndarray) -> np.ndarray:
    bits = np.asarray(values, np.float32).view(np.uint32)
    return ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)


class SafeTensors:
    """Tensors by name, decoded to float32 when they are asked for."""

    def __init__(self, data: bytes | memoryview | np.ndarray):
        self.data = memoryview(data)
        if len(self.data) < 8:
            raise ModelError("the file is too small for a header")
        size = struct.unpack("<Q", self.data[:8])[0]
        if 8 + size > len(self.data):
            raise ModelError(f"the header of {size} bytes overruns the file")
        try:
            header = json.loads(bytes(self.data[8 : 8 + size]))
        except ValueError as e:
            raise ModelError(f"the header is no JSON: {e}") from e
        self.body = self.data[8 + size :]
        self.infos = {k: v for k, v in header.items() if k != "__metadata__"}

    @classmethod
    def read(cls, path: str, mapped: bool = False) -> SafeTensors:
        try:
            if mapped:
                return cls(np.memmap(path, np.uint8, "r"))
            with open(path, "rb") as f:
                return cls(f.read())
        except OSError as e:
            raise SourceError(f"{path}: {e}") from e

    def names(self) -> list[str]:
        return sorted(self.infos)

    def __contains__(self, name: str) -> bool:
        return name in self.infos

    def tensor(self, name: str) -> np.ndarray:
        if name not in self.infos:
            raise ModelError(f"there is no tensor {name}")
        info = self.infos[name]
        kind, shape, (begin, end) = info["dtype"], info["shape"], info["data_offsets"]
        if kind not in ("F32", "F16", "BF16"):
            raise ModelError(f"{name} has the unsupported type {kind}")
        width = 4 if kind == "F32" else 2
        if not 0 <= begin <= end <= len(self.body):
            raise ModelError(f"{name} lies outside the file")
        if end - begin != width * int(np.prod(shape, dtype=np.int64)):
            raise TensorError(f"{name} has {end - begin} bytes for the shape {shape}")
        raw = self.body[begin:end]
        if kind == "BF16":
            values = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            values = np.frombuffer(raw, "<f4" if kind == "F32" else "<f2").astype(np.float32)
        return values.reshape(shape)

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, dtype, shape, begin, end): the header as rows."""
        rows = [(k, v["dtype"], v["shape"], *v["data_offsets"]) for k, v in sorted(self.infos.items())]
        return spark.createDataFrame(rows, "name string, dtype string, shape array<bigint>, begin long, end long")


def write(tensors: dict[str, np.ndarray], dtype: str = "F32") -> bytes:
    """A file's bytes; ``dtype`` is F32, F16 or BF16."""
    header, parts, at = {}, [], 0
    for name, values in tensors.items():
        if dtype == "BF16":
            raw = to_bfloat16(values).astype("<u2").tobytes()
        else:
            raw = np.asarray(values).astype({"F32": "<f4", "F16": "<f2"}[dtype]).tobytes()
        header[name] = {"dtype": dtype, "shape": list(np.shape(values)), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    head = json.dumps(header).encode()
    return struct.pack("<Q", len(head)) + head + b"".join(parts)
