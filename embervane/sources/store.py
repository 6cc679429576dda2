"""The chunk store: Parquet folders ``chunks`` and ``meta``, replaced as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from .files import path_order

CHUNKS = "path string, chunk_index int, text string, embedding array<float>"
META = "key string, value string"


class ChunkStore:
    """A store in one folder of any file system Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- files --------------------------------------------------------------------------------------------------
    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, path

    def _exists(self, name: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.folder}/{name}"))

    def _replace(self, df: DataFrame, name: str) -> None:
        """Write beside the old table, then swap: a failure leaves the old one as it was, and ``df`` may read it."""
        new, old = f"{self.folder}/.{name}-{uuid.uuid4().hex}", f"{self.folder}/.{name}-old-{uuid.uuid4().hex}"
        df.write.parquet(new)
        fs, path = self._fs()
        if fs.exists(path(f"{self.folder}/{name}")):
            fs.rename(path(f"{self.folder}/{name}"), path(old))
        if not fs.rename(path(new), path(f"{self.folder}/{name}")):
            raise StoreError(f"{name} could not be replaced")
        if fs.exists(path(old)):
            fs.delete(path(old), True)

    # -- meta ---------------------------------------------------------------------------------------------------
    def init(self) -> None:
        """Create what is missing."""
        if not self._exists("meta"):
            self._replace(self.spark.createDataFrame([], META), "meta")
        if not self._exists("chunks"):
            self.clear_chunks()

    def meta(self) -> DataFrame:
        return self.spark.read.schema(META).parquet(f"{self.folder}/meta") if self._exists("meta") else self.spark.createDataFrame([], META)

    def set_meta(self, key: str, value: str) -> None:
        self._replace(upsert(self.meta(), self.spark.createDataFrame([(key, value)], META), "key").coalesce(1), "meta")

    def get_meta(self, key: str) -> str | None:
        row = self.meta().where(F.col("key") == key).select("value").first()
        return row[0] if row else None

    # -- chunks -------------------------------------------------------------------------------------------------
    def clear_chunks(self) -> None:
        self._replace(self.spark.createDataFrame([], CHUNKS), "chunks")

    def replace_chunks(self, chunks: DataFrame) -> None:
        self._replace(chunks.select("path", F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.col("embedding").cast("array<float>").alias("embedding")), "chunks")

    def append_chunks(self, chunks: DataFrame) -> None:
        chunks.select("path", F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(f"{self.folder}/chunks")

    def chunks(self) -> DataFrame:
        """All chunks; order by ``order_key`` where order matters."""
        return self.spark.read.schema(CHUNKS).parquet(f"{self.folder}/chunks") if self._exists("chunks") else self.spark.createDataFrame([], CHUNKS)

    def count(self) -> int:
        return self.chunks().count()

    @staticmethod
    def order_key() -> list:
        """Insertion order: by path components, then chunk."""
        return [path_order("path"), F.col("chunk_index")]


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; only a local session without one has a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise StoreError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="embervane-")
    return named


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``new`` put in by ``key``."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)
