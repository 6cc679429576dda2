"""Text to vector: the embedding operator."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import fields
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..functions.text import pre_tokenize
from ..options import EmbedOptions
from ..sources.model import Layer, ModelConfig, ModelWeights, assemble
from ..sources.safetensors import SafeTensors
from . import encoder
from .tokenizer import Vocab, _pieces, pre_tokenize_str

#: Padded tokens in one kernel call: bounds a worker's memory whatever Arrow's batch size is.
TOKENS = 4096


class Embedder:
    """A model on the driver; ``column`` makes a column function that holds it as one broadcast."""

    def __init__(self, config: ModelConfig, vocab: Vocab, tensors: SafeTensors, do_lower_case: bool = True):
        self.config, self.vocab, self.do_lower_case = config, vocab, do_lower_case
        self.weights = assemble(config, tensors)

    @classmethod
    def load(cls, folder: str) -> Embedder:
        """From config.json, vocab.txt and model.safetensors."""
        paths = [Path(folder) / name for name in ("config.json", "vocab.txt", "model.safetensors")]
        for path in paths:
            if not path.is_file():
                raise ConfigError(path.name, f"not found in {folder}")
        return cls.from_bytes(*(p.read_bytes() for p in paths))

    @classmethod
    def from_bytes(cls, config: bytes, vocab: bytes, weights: bytes, do_lower_case: bool = True) -> Embedder:
        return cls(ModelConfig.parse(config.decode()), Vocab.parse(vocab.decode()), SafeTensors(weights), do_lower_case)

    def doubled(self) -> Embedder:
        """The same model, computed in double precision: for checks, not for speed."""

        def up(part: ModelWeights | Layer):
            own = {f.name: getattr(part, f.name) for f in fields(part)}
            return type(part)(**{k: v.astype(np.float64) if isinstance(v, np.ndarray) else [up(x) for x in v] if isinstance(v, list) else v for k, v in own.items()})

        out = copy.copy(self)
        out.weights = up(self.weights)
        return out

    @property
    def hidden_size(self) -> int:
        return self.config.hidden_size

    @property
    def max_position_embeddings(self) -> int:
        return self.config.max_position_embeddings

    @property
    def default_options(self) -> EmbedOptions:
        return EmbedOptions(max_length=min(self.max_position_embeddings, 128))

    def token_ids(self, text: str, max_length: int) -> list[int]:
        ids: list[int] = []
        for word in pre_tokenize_str(text, self.do_lower_case)[: max_length - 2]:
            ids += [self.vocab.ids[p] for p in self.vocab.pieces(word)]
        return ids[: max_length - 2]

    def embed(self, texts: list[str], options: EmbedOptions | None = None) -> np.ndarray:
        """Vectors of a few texts on the driver: [texts, hidden]."""
        options = (options or self.default_options).checked(self.max_position_embeddings)
        return vectors(self, [self.token_ids(t, options.max_length) for t in texts], options)

    def column(self, text: Column, spark: SparkSession, options: EmbedOptions | None = None) -> Column:
        """array<float> (double for a doubled model): the vector of each text, null for null.

        Words are cut off at ``max_length`` in the JVM before any is looked up; texts are batched by length and padded
        to the longest of their batch only, as padding can't change a real token's vector.
        """
        options = (options or self.default_options).checked(self.max_position_embeddings)
        words = F.slice(pre_tokenize(text, self.do_lower_case), 1, options.max_length - 2) if options.max_length > 2 else F.slice(pre_tokenize(text), 1, 0)
        shared = spark.sparkContext.broadcast(self)
        double = self.weights.words.dtype == np.float64
        kind = pa.float64() if double else pa.float32()

        @F.arrow_udf(T.ArrayType(T.DoubleType() if double else T.FloatType()))
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model, memo = shared.value, {}
            for lists in batches:
                ends, values, mask = _pieces(lists, model.vocab, memo)
                found = pooled(model, values, ends[:-1].astype(np.int64), np.diff(ends), options)
                sizes = np.full(len(lists), model.hidden_size)
                if mask is not None:
                    known = lists.is_valid().to_numpy(zero_copy_only=False)
                    found, sizes = found[known], sizes * known
                places = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.ListArray.from_arrays(places, pa.array(found.ravel(), kind), mask=mask)

        # not deterministic as far as the optimiser knows: no filter on the vector is pushed through, which would run the model again
        return run.asNondeterministic()(words)

    def with_embeddings(self, df: DataFrame, text: str = "text", out: str = "embedding", options: EmbedOptions | None = None) -> DataFrame:
        return df.withColumn(out, self.column(F.col(text), df.sparkSession, options))


def vectors(model: Embedder, pieces: list[list[int]], options: EmbedOptions) -> np.ndarray:
    """Pooled vectors of texts given as word-piece ids."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    return pooled(model, np.array([i for p in pieces for i in p], np.int64), np.cumsum(sizes) - sizes, sizes, options)


def pooled(model: Embedder, values: np.ndarray, begins: np.ndarray, sizes: np.ndarray, options: EmbedOptions) -> np.ndarray:
    """The same of texts whose ids, cut off at ``max_length``, lie in one array; batched by length."""
    out = np.zeros((len(sizes), model.hidden_size), model.weights.words.dtype)
    sizes = np.minimum(sizes, options.max_length - 2).astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    lengths = (sizes[order] + 2).tolist()
    vocab, at = model.vocab, 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[end] <= TOKENS:
            end += 1
        own, length = order[at:end], lengths[end - 1]
        place = np.arange(length)[None, :]
        last = sizes[own][:, None] + 1
        inner = (place > 0) & (place < last)
        ids = np.where(place == last, vocab.sep_id, vocab.pad_id)
        ids[:, 0] = vocab.cls_id
        ids[inner] = values[(begins[own][:, None] + place - 1)[inner]]
        mask = (place <= last).astype(np.int64)
        x = encoder.pool(encoder.encode(model.weights, model.config, ids, mask, options.pooling == "cls"), mask, options.pooling)
        out[own] = encoder.l2_normalize(x) if options.normalize else x
        at = end
    return out
