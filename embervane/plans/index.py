"""Indexing and searching a folder of texts."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, InvalidInput
from ..functions.text import CHUNK_OVERLAP, CHUNK_SIZE, chunk_array, truncate_display
from ..operators.embed import Embedder
from ..operators.search import search
from ..sources.files import is_remote, read_files, read_tree
from ..sources.store import ChunkStore

MODEL_KEY = "model_dir"


def chunked(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """A row for each chunk: ``docs``'s other columns, chunk_index and text. A generator: no shuffle."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(*others, F.posexplode(chunk_array(F.col(text), size, overlap)).alias("__pos", "__text"))
    return rows.select(*others, F.col("__pos").cast("int").alias("chunk_index"), F.col("__text").alias("text"))


def embed_chunks(files: DataFrame, model: Embedder) -> DataFrame:
    """(path, chunk_index, text, embedding) of (path, text): read, chunk, embed in one narrow stage."""
    return model.with_embeddings(chunked(files).select("path", "chunk_index", "text"), options=model.default_options)


def index_directory(spark: SparkSession, root: str, store: ChunkStore, model: Embedder, recursive: bool = True) -> int:
    """Replace the store's chunks by those of the folder; the number of chunks.

    The root is checked first and the old index stays until the new one is written in full. A root with a scheme (``s3a://``,
    ``hdfs://``) is listed and read by Spark, one of the local file system by ``read_files``, hidden files included.
    """
    files = read_tree(spark, root, recursive) if is_remote(root) else read_files(spark, root, recursive)
    store.replace_chunks(embed_chunks(files, model))
    return store.count()


def search_store(store: ChunkStore, query: str, model: Embedder, k: int = 5) -> DataFrame:
    """(path, chunk_index, text, score), best first; an empty index is an error."""
    chunks = store.chunks()
    if chunks.isEmpty():
        raise InvalidInput("the index is empty")
    vector = model.embed([query], model.default_options)[0].tolist()
    return search(chunks, vector, k, store.order_key()).select("path", "chunk_index", "text", "score")


def display(hits: DataFrame) -> list[str]:
    """Lines for a console."""
    rows = hits.withColumn("text", truncate_display(F.regexp_replace("text", "\n", " "), 120)).collect()  # k rows
    return [f"#{i} score={r.score:.4f} path={r.path} chunk={r.chunk_index} text={r.text}" for i, r in enumerate(rows)]


def resolve_model_dir(store: ChunkStore, given: str | None) -> str:
    """The folder that was given, else the one the store remembers."""
    folder = given or store.get_meta(MODEL_KEY)
    if not folder:
        raise ConfigError(MODEL_KEY, "no model folder was given or stored")
    return validate_model_dir(folder)


def validate_model_dir(folder: str) -> str:
    for name in ("config.json", "vocab.txt", "model.safetensors"):
        if not Path(folder, name).is_file():
            raise ConfigError(MODEL_KEY, f"{folder} has no {name}")
    return os.fspath(folder)
