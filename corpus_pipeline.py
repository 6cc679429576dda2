"""A corpus pipeline of five of the operators: quality, line dedup, near-dedup, sanitisation, packing.

Each stage takes what the one before kept, written as Parquet and read again. Stages that change texts bring
``n_chars``, where the table has it, up to date. A line is dropped from every document but the first that holds it, so a document of
which line dedup leaves nothing is one whose lines are all elsewhere; it goes.

Defined results: rows with null, empty or blank text are rejected by the first stage, with or without usable labels; a null doc_id is
kept and treated as its operator says; repeated rows are near copies of each other, of which one stays; further columns pass all stages
but the last, whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embervane.llm import lines, minhash, packing, pii, quality
from embervane.llm.common import ensure_checkpoint_dir, fresh
from embervane.sources.files import spread

#: No SQL: the classifier, MinHash and packing can't be expressed. The tests hold the stages against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that very many of them share, but for the first that holds each."""
    (had,) = fresh(docs, "had")
    full = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    left = lines.line_dedup(docs.withColumn(had, full))
    return _counted(left.where(full | ~F.col(had)).drop(had))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.near_dedup(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data and the terms that disclose it."""
    return _counted(pii.sanitised(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes in sequences of fixed length."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("pii", sanitise),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the folder of ``spark.checkpoint.dir``.

    Each stage's table is deleted once the next one is written; the last of them stays, as the result reads it.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
