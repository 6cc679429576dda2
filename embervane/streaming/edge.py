"""Embedding requests as rows, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import trim_white
from ..operators.embed import Embedder


def request_text(body: Column) -> Column:
    """The string field ``text`` of a JSON object; null if it is missing, of another type or blank."""
    whole = F.try_parse_json(body)
    text = F.when(F.schema_of_variant(F.try_variant_get(whole, "$.text", "variant")) == "STRING", F.try_variant_get(whole, "$.text", "string"))
    return F.when(trim_white(text) != "", text)


def respond(requests: DataFrame, model: Embedder, method: str = "method", body: str = "body") -> DataFrame:
    """``requests`` with ``status`` and ``response``: 405 unless POST, 400 for bad JSON or no text, else 200 with the vector."""

    def error(message: str) -> Column:
        return F.to_json(F.struct(F.lit(message).alias("error")))

    post = F.col(method) == "POST"
    valid = F.try_parse_json(F.col(body)).isNotNull()
    rows = requests.withColumn("__text", F.when(post, request_text(F.col(body))))
    rows = rows.withColumn("__vector", model.column(F.col("__text"), requests.sparkSession))
    answer = F.to_json(F.struct(F.size("__vector").alias("dim"), F.col("__vector").alias("embedding")))
    status = F.when(~F.coalesce(post, F.lit(False)), 405).when(F.col("__text").isNull(), 400).otherwise(200)
    response = (
        F.when(~F.coalesce(post, F.lit(False)), error("POST required"))
        .when(~F.coalesce(valid, F.lit(False)), error("invalid JSON body"))
        .when(F.col("__text").isNull(), error("text field required"))
        .otherwise(answer)
    )
    return rows.withColumns({"status": status, "response": response}).drop("__text", "__vector")


def serve(requests: DataFrame, model: Embedder, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Answer a stream of requests: stateless, each micro-batch goes to ``sink`` (idempotent by batch id)."""
    return respond(requests, model).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def embed_stream(texts: DataFrame, model: Embedder, out: str, checkpoint: str) -> StreamingQuery:
    """Append the vectors of a stream of texts (column ``text``) to a Parquet folder, once each."""
    return model.with_embeddings(texts).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
