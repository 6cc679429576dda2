"""Queries over whole tables, one for each corpus operator, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread
from . import bpe, embdedup, fingerprint, lines, minhash, packing, pii, quality, suffix, toxicity


LOOSE, STRICT = 0.4, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in a partition for each core where it is small: a file of one row group is one task."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2's ids say when they are decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.recoder(docs)(F.col("text")).alias("text"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.links(table(spark, sf_dir, "embeddings"))


def embedding_links_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 at a threshold that small tables of unrelated vectors reach, too."""
    return embdedup.links(table(spark, sf_dir, "embeddings"), LOOSE)


def op4_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def pii_mail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mail addresses op4 takes out of each document."""
    return op4_pii_sanitisation(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(r"\[EMAIL\]")).cast("long").alias("mails"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 without the digest, which SQL lacks."""
    return op7_fingerprints(spark, sf_dir).drop("fingerprint")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text")


def line_dedup_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 at a threshold that many lines of a small table pass."""
    return lines.line_dedup(table(spark, sf_dir, "documents"), STRICT).select("doc_id", "text")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def packing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens of each document op9 has placed, in how many pieces."""
    return op9_best_fit_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").cast("long").alias("tokens"), F.count(F.lit(1)).alias("pieces"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_pii_sanitisation": op4_pii_sanitisation,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "fingerprint_groups": fingerprint_groups,
    "embedding_links_loose": embedding_links_loose,
    "line_dedup_strict": line_dedup_strict,
    "packing_totals": packing_totals,
    "bpe_decoded": bpe_decoded,
    "pii_mail_counts": pii_mail_counts,
}

SQL: dict[str, str] = {
    "op3_embedding_near_dedup": embdedup.sql(),
    "embedding_links_loose": embdedup.sql(LOOSE),
    "op5_suffix_array_dedup": suffix.SQL,
    "op8_line_dedup": lines.sql(),
    "line_dedup_strict": lines.sql(STRICT),
    "fingerprint_groups": fingerprint.GROUPS_SQL,
    "op10_minhash_near_dedup": minhash.SQL,
    "packing_totals": packing.TOTALS_SQL,
    "bpe_decoded": "SELECT doc_id, text FROM documents",
    "pii_mail_counts": pii.MAILS_SQL,
}
