"""Text files as rows (path, text)."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, SourceError

EXTENSIONS = (".md", ".txt")


def list_files(root: str, recursive: bool = True) -> list[tuple[str, str]]:
    """(path, path relative to the root) of all .md and .txt files, hidden ones too, in component-wise order.

    A single file is a root of its own, whose relative path is its name.
    """
    base = Path(root)
    if not base.exists():
        raise SourceError(f"{root} doesn't exist")
    if base.is_file():
        if base.suffix not in EXTENSIONS:
            raise InvalidInput(f"{root} is no .md or .txt file")
        return [(str(base), base.name)]
    found = []
    for folder, folders, names in os.walk(base):
        if not recursive:
            folders.clear()
        found += [Path(folder) / n for n in names if Path(n).suffix in EXTENSIONS and (Path(folder) / n).is_file()]
    return [(str(p), p.relative_to(base).as_posix()) for p in sorted(found, key=lambda p: p.relative_to(base).parts)]


def read_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, text), path relative to the root. Invalid UTF-8 fails the query, naming the file.

    The listing is the driver's, as Spark's own skips hidden files; the files are read by the executors, so the root must be
    a folder that all of them share.
    """
    files = list_files(root, recursive)
    if not files:
        return spark.createDataFrame([], "path string, text string")
    listed = spark.createDataFrame(files, "file string, path string").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))

    def load(rows):
        import pyarrow as pa

        for batch in rows:
            for file, path in zip(batch["file"].to_pylist(), batch["path"].to_pylist()):
                with open(file, "rb") as f:
                    raw = f.read()
                try:
                    text = raw.decode("utf-8")
                except UnicodeDecodeError as e:
                    raise ValueError(f"{path} is no UTF-8 text: {e}") from e
                yield pa.RecordBatch.from_pydict({"path": [path], "text": [text]})

    return listed.mapInArrow(load, "path string, text string")


def read_tree(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """The same from any file system Spark knows, listed and read by Spark: for large trees without hidden files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{md,txt}").load(root)
    base = F.lit(re.sub("^file:/+", "/", root).rstrip("/") + "/")
    path = F.regexp_replace(files["path"], "^file:/+", "/")
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).otherwise(F.raise_error(F.concat(path, F.lit(" is no UTF-8 text"))))
    return files.select(F.replace(path, base, F.lit("")).alias("path"), text.alias("text"))


def is_remote(root: str) -> bool:
    """Whether a root is named by the scheme of a file system other than the machine's own."""
    scheme, found, _ = root.partition("://")
    return bool(found) and scheme != "file"


def spread(df: DataFrame, least_bytes: int = 16 << 20) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it is smaller than ``least_bytes`` for each of them.

    A small Parquet file has one row group and so one task, whatever work follows. Larger tables are left as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < size < cores * least_bytes else df


def path_order(path: str = "path"):
    """Sort key that orders paths component by component."""
    return F.split(F.col(path), "/")
