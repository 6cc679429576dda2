"""One query over whole tables for each operator, and the same in DuckDB SQL where it can express it."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from ..operators import linalg as la
from ..operators import search as s
from ..operators import tokenizer as tk
from ..operators.embed import Embedder
from ..operators.pooling import cls_pool, mean_pool
from ..options import EmbedOptions
from ..sources.files import spread
from ..sources.model import ModelConfig, seeded
from ..sources.safetensors import SafeTensors, write
from ..sources.store import ChunkStore, shared_folder, upsert
from ..streaming.edge import respond
from .index import chunked

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOKENS = (
    "[PAD] [UNK] [CLS] [SEP] [MASK] . , the of and to a in is on it for was with that th er an en re he ed es ing de la le el que der die und est "
    "##th ##er ##an ##en ##re ##he ##ed ##es ##ing ##ion ##tion ##nd ##st ##at ##or ##ti ##ou ##ea ##sh ##ly ##wh ##ble ##nt ##ch ##le ##on "
    "##in ##ha ##the ##au ##oi ##ai ##aux ##que ##ment ##ie ##ge ##be ##ver ##ung ##ado ##os ##cion ##as"
).split()
MAX_LENGTH = 128
PREFIX = 120
TOP = 5
EVERY = 50


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are work for every core, in however few row groups they are."""
    return spread(table(spark, sf_dir, "documents"))


@cache
def vocab() -> tk.Vocab:
    return tk.Vocab(TOKENS)


@cache
def model() -> Embedder:
    """A small seeded model in which every weight matters."""
    config = ModelConfig(len(TOKENS), 16, 2, 4, 32, MAX_LENGTH)
    return Embedder(config, vocab(), SafeTensors(write(seeded(config))))


# -- text ---------------------------------------------------------------------------------------------------------
def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{t.TRIM}', '', 'g')"


_CLEAN = f"regexp_replace(regexp_replace(text, '[{t.CONTROL}]', '', 'g'), '[{t.BLANK}]', ' ', 'g')"


def _spaced(x: str) -> str:
    return f"regexp_replace({x}, '([{t.IDEOGRAPH}])', ' \\1 ', 'g')"


_TOKENS = f"regexp_extract_all(strip_accents(lower({_spaced(_CLEAN)})), '{t.TOKEN}')"


def _text_query(name: str, column, sql: str) -> None:
    query(name, f"SELECT doc_id, {sql} AS text FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", column(F.col("text")).alias("text")))


_text_query("text_trim", t.trim_white, _trim("text"))
_text_query("char_prefix", lambda c: t.char_prefix(c, PREFIX), f"substring(text, 1, {PREFIX})")
_text_query("truncate_display", lambda c: t.truncate_display(c, PREFIX), f"CASE WHEN length(text) <= {PREFIX} THEN text ELSE substring(text, 1, {PREFIX}) || '...' END")
_text_query("clean_text", t.clean_text, _CLEAN)
_text_query("cjk_spacing", t.space_ideographs, _spaced("text"))
_text_query("lowercase", F.lower, "lower(text)")
_text_query("strip_accents", t.strip_accents, "strip_accents(text)")
_text_query("pre_tokenize", lambda c: F.array_join(t.pre_tokenize(c), " "), f"array_to_string({_TOKENS}, ' ')")

_CHUNKS = f"""
WITH body AS (SELECT doc_id, source, {_trim("text")} AS b FROM documents),
piece AS (
  SELECT doc_id, source, w, {_trim(f"substring(b, w * {t.CHUNK_SIZE - t.CHUNK_OVERLAP} + 1, {t.CHUNK_SIZE})")} AS p
  FROM body, unnest(range(0, CASE WHEN length(b) <= {t.CHUNK_SIZE} THEN 1
    ELSE 1 + CAST(ceil((length(b) - {t.CHUNK_SIZE}) / {t.CHUNK_SIZE - t.CHUNK_OVERLAP}.0) AS BIGINT) END)) AS u(w)
  WHERE b <> ''),
chunk AS (
  SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1 AS INTEGER) AS chunk_index, p AS text
  FROM piece WHERE p <> '')
"""


@query("chunk_documents", f"{_CHUNKS} SELECT doc_id, chunk_index, text FROM chunk")
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunked(docs(spark, d).select("doc_id", "text"))


@query("chunk_counts", f"{_CHUNKS} SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks FROM chunk GROUP BY doc_id")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counted from the array, so no row is generated and nothing is shuffled."""
    n = F.size(t.chunk_array(F.col("text"))).cast("long")
    return docs(spark, d).select("doc_id", n.alias("chunks")).where("chunks > 0")


# -- tokens -------------------------------------------------------------------------------------------------------
_WORDS = f"words AS (SELECT doc_id, {_TOKENS} AS words FROM documents), token AS (SELECT unnest(words) AS token FROM words)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.explode(t.pre_tokenize(F.col("text"))).alias("token"))


@query("token_frequencies", f"WITH {_WORDS} SELECT token, CAST(count(*) AS BIGINT) AS n FROM token GROUP BY token")
def token_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _quote(x: str) -> str:
    return x.replace("'", "''")


def _pieces_sql(word: str) -> str:
    heads, tails = (_quote(p) for p in tk.piece_patterns(vocab()))
    head = f"regexp_extract({word}, '^(?:{heads})')"
    more = f"regexp_extract_all(substring({word}, length({head}) + 1), '{tails}')"
    return (
        f"CASE WHEN {head} <> '' AND array_to_string({more}, '') = substring({word}, length({head}) + 1) AND strlen({word}) <= {tk.MAX_WORD_BYTES} "
        f"THEN list_concat([{head}], list_transform({more}, lambda p: '##' || p)) ELSE ['{tk.UNK}'] END"
    )


@query("wordpiece", f"WITH {_WORDS}, one AS (SELECT DISTINCT token FROM token) SELECT token, array_to_string({_pieces_sql('token')}, ' ') AS pieces FROM one")
def wordpiece(spark: SparkSession, d: str) -> DataFrame:
    one = tokens(spark, d).distinct()
    return one.select("token", F.array_join(tk.word_pieces(F.array("token"), vocab(), spark), " ").alias("pieces"))


QUERIES["wordpiece_native"] = lambda spark, d: tokens(spark, d).distinct().select("token", F.array_join(tk.word_pieces_native(F.col("token"), vocab()), " ").alias("pieces"))
SQL["wordpiece_native"] = SQL["wordpiece"]

_VOCAB = "[" + ", ".join(f"'{_quote(x)}'" for x in TOKENS) + "]"


def _ids_sql(n: int = MAX_LENGTH) -> str:
    """Word-piece ids of each chunk's first ``n - 2`` pieces, as table ``every``."""
    return f"""
{_CHUNKS}, words AS (SELECT doc_id, chunk_index, {_TOKENS} AS words FROM chunk),
cut AS (SELECT doc_id, chunk_index, unnest(words[1:{n - 2}]) AS w, generate_subscripts(words[1:{n - 2}], 1) AS i FROM words),
pieces AS (SELECT doc_id, chunk_index, i, {_pieces_sql("w")} AS p FROM cut),
ids AS (
  SELECT doc_id, chunk_index, flatten(list(list_transform(p, lambda x: list_position({_VOCAB}, x) - 1) ORDER BY i))[1:{n - 2}] AS ids
  FROM pieces GROUP BY doc_id, chunk_index),
every AS (SELECT c.doc_id, c.chunk_index, c.text, coalesce(ids, CAST([] AS INTEGER[])) AS ids FROM chunk c LEFT JOIN ids USING (doc_id, chunk_index))
"""


_IDS = _ids_sql()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunked(docs(spark, d).select("doc_id", "text"))


def encoded(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("doc_id", "chunk_index", tk.encode(F.col("text"), vocab(), spark, MAX_LENGTH).alias("e"))


@query(
    "encode_ids",
    f"""{_IDS} SELECT doc_id, chunk_index, array_to_string(list_concat(list_concat([{vocab().cls_id}], ids), [{vocab().sep_id}]), ' ')
    || repeat(' {vocab().pad_id}', {MAX_LENGTH} - 2 - len(ids)) AS input_ids FROM every""",
)
def encode_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spark, d).select("doc_id", "chunk_index", F.array_join(F.col("e.input_ids").cast("array<string>"), " ").alias("input_ids"))


@query("attention_mask_len", f"{_IDS} SELECT doc_id, chunk_index, CAST(len(ids) + 2 AS BIGINT) AS n FROM every")
def attention_mask_len(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spark, d).select("doc_id", "chunk_index", F.aggregate("e.attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n"))


@query("vocab_lookup", f"WITH {_WORDS}, one AS (SELECT DISTINCT token FROM token) SELECT token, CAST(coalesce(list_position({_VOCAB}, token) - 1, {vocab().unk_id}) AS INTEGER) AS token_id FROM one")
def vocab_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tk.lookup(tokens(spark, d).distinct(), vocab()).select("token", "token_id")


# -- vectors ------------------------------------------------------------------------------------------------------
_E = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, list_reverse(CAST(embedding AS DOUBLE[])) AS r FROM embeddings)"
_M = f"{_E}, m AS (SELECT vec_id AS i, unnest(range(0, len(v))) AS j, unnest(v) AS v FROM e)"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return la.long_form(embeddings(spark, d), "vec_id", "embedding")


def rounded(df: DataFrame, column: str = "v") -> DataFrame:
    return df.withColumn(column, F.round(column, 6) + F.lit(0.0))


def quickly_rounded(df: DataFrame, column: str = "v") -> DataFrame:
    """The same for very many doubles: scaled, to the nearest, halves away from zero, as DuckDB does it. ``round`` goes by BigDecimal, which costs over 1 us."""
    x = F.col(column) * 1e6
    whole = F.when(F.abs(x - F.rint(x)) == 0.5, x + F.signum(x) * 0.5).otherwise(F.rint(x))
    return df.withColumn(column, whole / 1e6 + F.lit(0.0))


def _round(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _cells(name: str, column, sql: str) -> None:
    """Long form of a vector computed from a row's vector and its reverse."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        e = embeddings(spark, d).select("vec_id", F.col("embedding").alias("a"), F.reverse("embedding").alias("b"))
        cells = e.select("vec_id", F.posexplode(column(F.col("a"), F.col("b"))).alias("d", "v"))
        return rounded(cells.select("vec_id", F.col("d").cast("long").alias("d"), "v"))

    query(name, f"{_E}, x AS (SELECT vec_id, {sql} AS x FROM e), c AS (SELECT vec_id, unnest(range(0, len(x))) AS d, unnest(x) AS v FROM x) SELECT vec_id, d, {_round('v')} AS v FROM c")(run)


_SUM = "list_sum(list_transform(v, lambda x: {0}))"
_cells("vec_add", v.add, "list_transform(range(1, len(v) + 1), lambda i: v[i] + r[i])")
_cells("vec_mul", v.mul, "list_transform(range(1, len(v) + 1), lambda i: v[i] * r[i])")
_cells("vec_scale", lambda a, b: v.scale(a, 2.5), "list_transform(v, lambda x: x * 2.5)")
_cells("vec_shift", lambda a, b: v.shift(a, 0.25), "list_transform(v, lambda x: x + 0.25)")
_cells("softmax", lambda a, b: v.softmax(a), f"list_transform(v, lambda y: exp(y - list_max(v)) / {_SUM.format('exp(x - list_max(v))')})")
_cells("gelu", lambda a, b: v.gelu(a), f"list_transform(v, lambda x: 0.5 * x * (1 + tanh({v.GELU_SCALE} * (x + {v.GELU_CUBE} * x * x * x))))")
_cells("l2_normalize", lambda a, b: v.l2_normalize(a), f"list_transform(v, lambda y: y / greatest(sqrt({_SUM.format('x * x')}), 1e-12))")
_cells(
    "layer_norm", lambda a, b: v.layer_norm(a),
    f"list_transform(v, lambda y: (y - list_avg(v)) / sqrt({_SUM.format('(x - list_avg(v)) * (x - list_avg(v))')} / len(v) + 1e-12))",
)
_cells("blob_roundtrip", lambda a, b: v.doubles(v.from_blob(v.to_blob(a))), "v")


@query("vec_dot", f"{_E} SELECT vec_id, {_round('list_dot_product(v, r)')} AS v FROM e")
def vec_dot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(embeddings(spark, d).select("vec_id", v.dot(F.col("embedding"), F.reverse("embedding")).alias("v")))


@query("vec_sum", f"{_E} SELECT vec_id, {_round('list_sum(v)')} AS v FROM e")
def vec_sum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(embeddings(spark, d).select("vec_id", v.total(F.col("embedding")).alias("v")))


@query("transpose", f"{_M} SELECT j AS i, i AS j, v FROM m")
def transpose(spark: SparkSession, d: str) -> DataFrame:
    return la.transpose(matrix(spark, d))


@query("reshape", f"{_M} SELECT CAST((i * 64 + j) // 32 AS BIGINT) AS i, CAST((i * 64 + j) % 32 AS BIGINT) AS j, v FROM m")
def reshape(spark: SparkSession, d: str) -> DataFrame:
    return la.reshape(matrix(spark, d), 64, 32)


@query("slice_first", f"{_M} SELECT j, v FROM m WHERE i = 7")
def slice_first(spark: SparkSession, d: str) -> DataFrame:
    return la.slice_first(matrix(spark, d), 7)


@query("tensor_shape", f"{_M} SELECT 2 AS rank, max(i) + 1 AS rows, max(j) + 1 AS columns, (max(i) + 1) * (max(j) + 1) AS numel FROM m")
def tensor_shape(spark: SparkSession, d: str) -> DataFrame:
    return la.shape(matrix(spark, d))


@query("tensor_get", f"{_M} SELECT v FROM m WHERE i = 7 AND j = 3")
def tensor_get(spark: SparkSession, d: str) -> DataFrame:
    return la.get(matrix(spark, d), 7, 3)


@query("tensor_set", f"{_M} SELECT i, j, CASE WHEN i = 7 AND j = 3 THEN 42.5 ELSE v END AS v FROM m")
def tensor_set(spark: SparkSession, d: str) -> DataFrame:
    return la.set_cell(matrix(spark, d), 7, 3, 42.5)


@query("tensor_equal", "SELECT 'itself' AS with_what, true AS equal UNION ALL SELECT 'one cell changed', false UNION ALL SELECT 'transposed twice', true UNION ALL SELECT 'transposed', false")
def tensor_equal(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    others = {"itself": m, "one cell changed": la.set_cell(m, 7, 3, 42.5), "transposed twice": la.transpose(la.transpose(m)), "transposed": la.transpose(m)}
    out = [la.equal(m, other).select(F.lit(name).alias("with_what"), "equal") for name, other in others.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "tensor_constructors",
    """SELECT 'full' AS made, i // 3 AS i, i % 3 AS j, 2.5::DOUBLE AS v FROM range(12) AS r(i) UNION ALL SELECT 'ones', i // 3, i % 3, 1.0 FROM range(12) AS r(i)
    UNION ALL SELECT 'zeros', i // 3, i % 3, 0.0 FROM range(12) AS r(i) UNION ALL SELECT 'values', i // 3, i % 3, i / 2.0 FROM range(12) AS r(i)""",
)
def tensor_constructors(spark: SparkSession, d: str) -> DataFrame:
    made = {"full": la.full(spark, 4, 3, 2.5), "ones": la.ones(spark, 4, 3), "zeros": la.zeros(spark, 4, 3), "values": la.from_values(spark, [k / 2 for k in range(12)], 4, 3)}
    out = [m.select(F.lit(name).alias("made"), "i", "j", "v") for name, m in made.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("flat_index", f"{_M} SELECT i, j, i * 64 + j AS place FROM m")
def flat_index(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    rows = m.agg(F.max("i") + 1).first()[0]
    return m.select("i", "j", la.flat_index([F.col("i"), F.col("j")], [rows, 64]).alias("place"))


@query("stack", f"{_M} SELECT CAST(0 AS BIGINT) AS k, i, j, v FROM m UNION ALL SELECT CAST(1 AS BIGINT), j, i, v FROM m")
def stack(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return la.stack(m, la.transpose(m))


@query("sum_axis", f"{_M} SELECT j, {_round('sum(v)')} AS v FROM m GROUP BY j")
def sum_axis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(la.sum_axis(matrix(spark, d), 0))


@query("sum_axis_last", f"{_M} SELECT i, {_round('sum(v)')} AS v FROM m GROUP BY i")
def sum_axis_last(spark: SparkSession, d: str) -> DataFrame:
    return rounded(la.sum_axis(matrix(spark, d), 1))


@query("add_bias", f"{_M}, b AS (SELECT j, avg(v) AS b FROM m GROUP BY j) SELECT i, j, {_round('v + b')} AS v FROM m JOIN b USING (j)")
def add_bias(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return rounded(la.add_bias(m, m.groupBy("j").agg(F.avg("v").alias("v"))))


@query("add_broadcast", f"{_M}, b AS (SELECT i, sum(v) AS b FROM m GROUP BY i) SELECT i, j, {_round('v + b')} AS v FROM m JOIN b USING (i)")
def add_broadcast(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return rounded(la.add_broadcast(m, la.sum_axis(m, 1), ["i"]))


@query("mul_broadcast_last", f"{_M}, b AS (SELECT i, max(v) AS b FROM m GROUP BY i) SELECT i, j, {_round('v * b')} AS v FROM m JOIN b USING (i)")
def mul_broadcast_last(spark: SparkSession, d: str) -> DataFrame:
    m = matrix(spark, d)
    return rounded(la.mul_broadcast_last(m, m.groupBy("i").agg(F.max("v").alias("v"))))


_GRAM = "SELECT {0} a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM m a JOIN m b ON a.i = b.i {1} GROUP BY ALL"


@query("matmul_gram", f"{_M} {_GRAM.format('', '')}")
def matmul_gram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(la.gram(embeddings(spark, d), "embedding"))


@query("matmul_long", f"{_M} {_GRAM.format('', '')}")
def matmul_long(spark: SparkSession, d: str) -> DataFrame:
    """The same product by the general operator: transpose and join."""
    m = matrix(spark, d)
    return rounded(la.matmul(la.transpose(m), m))


@query("batched_matmul_by_label", f"{_E}, m AS (SELECT vec_id AS i, label, unnest(range(0, len(v))) AS j, unnest(v) AS v FROM e) {_GRAM.format('a.label,', '')}")
def batched_matmul_by_label(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    m = e.select("label", F.col("vec_id").alias("i"), F.posexplode(v.doubles(F.col("embedding"))).alias("j", "v")).select(F.col("label").alias("b"), "i", F.col("j").cast("long").alias("j"), "v")
    turned = m.select("b", F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return rounded(la.batched_matmul(turned, m)).withColumnRenamed("b", "label")


QUERIES["gram_by_label"] = lambda spark, d: rounded(la.gram(embeddings(spark, d), "embedding", ["label"]))
SQL["gram_by_label"] = SQL["batched_matmul_by_label"]


@query("mean_pool_by_label", f"{_E}, m AS (SELECT label, unnest(range(0, len(v))) AS d, unnest(v) AS v FROM e) SELECT label, d, {_round('avg(v)')} AS v FROM m GROUP BY ALL")
def mean_pool_by_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mean_pool(embeddings(spark, d), "label", "embedding"))


@query("cls_pool_by_label", f"{_E}, p AS (SELECT label, arg_min(v, vec_id) AS v FROM e GROUP BY label) SELECT label, unnest(range(0, len(v))) AS d, {_round('unnest(v)')} AS v FROM p")
def cls_pool_by_label(spark: SparkSession, d: str) -> DataFrame:
    p = cls_pool(embeddings(spark, d), "label", "vec_id", "embedding").select("label", F.posexplode(v.doubles(F.col("embedding"))).alias("d", "v"))
    return rounded(p.select("label", F.col("d").cast("long").alias("d"), "v"))


_COSINE = "list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 1e-12)"


@query("cosine_pairs", f"{_E} SELECT a.vec_id AS a, b.vec_id AS b, {_round(_COSINE)} AS score FROM e a JOIN e b ON len(a.v) = len(b.v) WHERE a.vec_id % {EVERY} = 0")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A set of queries, each vector whose id is divisible by 50, against all vectors."""
    e = embeddings(spark, d)
    asked = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return quickly_rounded(s.score_join(asked, e.select(F.col("vec_id").alias("id"), "embedding")).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score"), "score")


@query(
    "cosine_top_k",
    f"""{_E}, x AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS s FROM e a JOIN e b ON len(a.v) = len(b.v)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM x)
    SELECT query_id, id, {_round("s")} AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {TOP}""",
)
def cosine_top_k(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return rounded(s.top_k_join(e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("id"), "embedding"), TOP), "score")


@query("dim_filter", "SELECT vec_id FROM embeddings WHERE len(embedding[1:62 + vec_id % 3]) = 64")
def dim_filter(spark: SparkSession, d: str) -> DataFrame:
    """Vectors cut to 62, 63 and 64 elements, of which the last stay."""
    cut = F.slice("embedding", F.lit(1), (F.col("vec_id") % 3 + 62).cast("int"))
    return s.dim_filter(embeddings(spark, d).select("vec_id", cut.alias("embedding")), 64).select("vec_id")


def _half(name: str, decode, bits: int, bias: int) -> None:
    size, top = 1 << bits, (1 << (15 - bits)) - 1
    low = 2.0 ** (1 - bias - bits)
    sql = f"""
    WITH c AS (SELECT range AS code, CASE WHEN range & 32768 <> 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s, (range >> {bits}) & {top} AS e, range & {size - 1} AS m FROM range(65536))
    SELECT CAST(code AS INTEGER) AS code, CASE WHEN e = 0 THEN s * m * {low!r}::DOUBLE ELSE s * pow(2.0::DOUBLE, e - {bias + bits}) * (m + {size}) END + 0.0 AS v FROM c WHERE e < {top}"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        code = F.col("id").cast("int")
        out = spark.range(65536).select(code.alias("code"), (decode(code) + F.lit(0.0)).alias("v"))
        return out.where(~F.isnan("v") & (F.abs("v") < float("inf")))

    query(name, sql)(run)


_half("f16_decode", v.f16_decode, 10, 15)
_half("bf16_decode", v.bf16_decode, 7, 127)


# -- store, requests, models --------------------------------------------------------------------------------------
@query(
    "meta_upsert",
    """SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'region ' || n_regionkey ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation
    UNION ALL SELECT 'region:' || r_name, 'region ' || r_regionkey FROM region""",
)
def meta_upsert(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    old = nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    new = nation.where("n_regionkey = 1").select(F.col("n_name").alias("key"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("value"))
    more = region.select(F.concat(F.lit("region:"), "r_name").alias("key"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).alias("value"))
    return upsert(old, new.unionByName(more), "key")


def _store(spark: SparkSession) -> ChunkStore:
    return ChunkStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, d: str) -> ChunkStore:
    """Chunks with a small vector each, written to a new store in the session's shared folder."""
    store = _store(spark)
    rows = chunked(docs(spark, d).select("doc_id", "source", "text"))
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    vector = F.array(F.col("chunk_index").cast("float"), F.char_length("text").cast("float"))
    store.replace_chunks(rows.select(path.alias("path"), "chunk_index", "text", vector.alias("embedding")))
    return store


@query("chunk_store_roundtrip", f"{_CHUNKS} SELECT source || '/' || doc_id AS path, chunk_index, text, CAST(length(text) AS DOUBLE) AS size FROM chunk")
def chunk_store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).chunks().select("path", "chunk_index", "text", F.element_at("embedding", 2).cast("double").alias("size"))


@query("chunk_count", f"{_CHUNKS} SELECT CAST(count(*) AS BIGINT) AS n FROM chunk")
def chunk_count(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d).chunks().agg(F.count(F.lit(1)).alias("n"))


@query("store_lookup", "SELECT r_name AS key, CAST(r_regionkey + 10 AS VARCHAR) AS value FROM region UNION ALL SELECT 'NOWHERE', NULL")
def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Keys set, set again, and looked up one by one."""
    store = _store(spark)
    store.init()
    known = {r.r_name: r.r_regionkey for r in table(spark, d, "region").collect()}  # a handful by definition
    for shift in (0, 10):
        for name, key in known.items():
            store.set_meta(name, str(key + shift))
    return spark.createDataFrame([(name, store.get_meta(name)) for name in [*known, "NOWHERE"]], "key string, value string")


@query("store_append_truncate", "SELECT CAST(10 AS BIGINT) AS first, CAST(15 AS BIGINT) AS more, CAST(0 AS BIGINT) AS cleared, CAST(5 AS BIGINT) AS again")
def store_append_truncate(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    store.init()

    def rows(n: int) -> DataFrame:
        return spark.range(n).select(F.format_string("f%d", "id").alias("path"), F.lit(0).alias("chunk_index"), F.lit("text").alias("text"), F.array(F.lit(1.0)).alias("embedding"))

    store.replace_chunks(rows(10))
    counts = [store.count()]
    for step in (lambda: store.append_chunks(rows(5)), store.clear_chunks, lambda: store.append_chunks(rows(5))):
        step()
        counts.append(store.count())
    return spark.createDataFrame([tuple(counts)], "first long, more long, cleared long, again long")


_BLANK_TEXT = f"coalesce({_trim('text')}, '') = ''"


@query(
    "edge_request",
    f"""SELECT conv_id, turn, CASE WHEN role <> 'user' AND turn % 3 = 0 THEN 405 WHEN role <> 'user' OR {_BLANK_TEXT} THEN 400 ELSE 200 END AS status,
    CASE WHEN role = 'user' AND NOT {_BLANK_TEXT} THEN '' WHEN role <> 'user' AND turn % 3 = 0 THEN 'POST required' WHEN role <> 'user' AND turn % 3 = 1 THEN 'invalid JSON body'
    ELSE 'text field required' END AS error, CASE WHEN role = 'user' AND NOT {_BLANK_TEXT} THEN 16 ELSE 0 END AS dim FROM conversations""",
)
def edge_request(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of a user is a request; those of others stand for requests of a wrong method, without JSON, or without a text."""
    kind, user = F.col("turn") % 3, F.col("role") == "user"
    body = F.when(user | (kind == 0), F.to_json(F.struct("text"))).when(kind == 1, F.lit("{no json")).otherwise(F.lit('{"text": 5}'))
    requests = spread(table(spark, d, "conversations")).select("conv_id", "turn", F.when(user | (kind != 0), "POST").otherwise("GET").alias("method"), body.alias("body"))
    answers = respond(requests, model())
    error, dim = F.get_json_object("response", "$.error"), F.get_json_object("response", "$.dim").cast("int")
    return answers.select("conv_id", "turn", "status", F.coalesce(error, F.lit("")).alias("error"), F.coalesce(dim, F.lit(0)).alias("dim"))


@cache
def tiny() -> Embedder:
    """One layer."""
    config = ModelConfig(len(TOKENS), 8, 1, 2, 16, MAX_LENGTH)
    return Embedder(config, vocab(), SafeTensors(write(seeded(config, 2))))


@cache
def distilled() -> Embedder:
    """The other family, from the bytes of its three files."""
    config = ModelConfig(len(TOKENS), 8, 2, 2, 16, MAX_LENGTH, model_type="distilbert")
    text = json.dumps({k: x for k, x in vars(config).items() if x is not None})
    return Embedder.from_bytes(text.encode(), "".join(f"{x}\n" for x in TOKENS).encode(), write(seeded(config, 3)))


def _numbers(x: np.ndarray) -> str:
    return "[" + ", ".join(f"{float(c):.17e}" for c in x) + "]"


def _encoder_sql(m: Embedder, final: str) -> str:
    """Tokens, embeddings, all encoder layers over lists; the last table is ``y`` (doc_id, chunk_index, p, v)."""
    w, config = m.weights, m.config
    h, heads, width = config.hidden_size, config.num_attention_heads, config.head_dim
    key = "doc_id, chunk_index"
    added = w.positions.astype(float) + (w.types[0].astype(float) if w.types is not None else 0.0)

    def each(n: int, cell) -> str:
        return "[" + ", ".join(cell(i) for i in range(1, n + 1)) + "]"

    def rows(x: np.ndarray, name: str) -> str:
        return f"{name}(i, w) AS (VALUES " + ", ".join(f"({i}, {_numbers(row)})" for i, row in enumerate(x)) + ")"

    def linear(x: str, matrix: np.ndarray, bias: np.ndarray) -> str:
        return "[" + ", ".join(f"list_dot_product({_numbers(matrix[:, i])}, {x}) + {float(bias[i]):.17e}" for i in range(matrix.shape[1])) + "]"

    parts = [
        rows(w.words, "word"), rows(added, "place"),
        f"tok AS (SELECT {key}, unnest(range(0, len(ids) + 2)) AS p, unnest(list_concat(list_concat([{m.vocab.cls_id}], ids), [{m.vocab.sep_id}])) AS id FROM every)",
        f"x AS (SELECT {key}, p, {each(h, lambda i: f'a.w[{i}] + b.w[{i}]')} AS v FROM tok JOIN word a ON a.i = id JOIN place b ON b.i = p)",
    ]

    def norm(out: str, of: str, gamma: np.ndarray, beta: np.ndarray) -> None:
        parts.append(f"{out}_m AS (SELECT {key}, p, v, list_avg(v) AS m FROM {of})")
        parts.append(f"{out}_c AS (SELECT {key}, p, {each(h, lambda i: f'v[{i}] - m')} AS c FROM {out}_m)")
        parts.append(f"{out}_s AS (SELECT {key}, p, c, sqrt(list_dot_product(c, c) / {h} + {config.layer_norm_eps!r}) AS s FROM {out}_c)")
        parts.append(f"{out} AS MATERIALIZED (SELECT {key}, p, {each(h, lambda i: f'c[{i}] / s * {float(gamma[i - 1]):.17e} + {float(beta[i - 1]):.17e}')} AS v FROM {out}_s)")

    norm("x0", "x", w.gamma, w.beta)
    last = "x0"
    for n, layer in enumerate(w.layers):
        t = f"l{n}"
        qkv = ", ".join(f"{linear('v', getattr(layer, k), getattr(layer, f'{k}_bias'))} AS {k}_" for k in "qkv")
        part = "[h * {0} + 1:h * {0} + {0}]".format(width)
        parts += [
            f"{t}_q AS (SELECT {key}, p, {qkv} FROM {last})",
            f"{t}_h AS MATERIALIZED (SELECT {key}, p, h, q_{part} AS q, k_{part} AS k, v_{part} AS v FROM {t}_q, range({heads}) AS r(h))",
            f"{t}_k AS (SELECT {key}, h, list(k ORDER BY p) AS ks, {each(width, lambda i: f'list(v[{i}] ORDER BY p)')} AS vs FROM {t}_h GROUP BY {key}, h)",
            f"{t}_a AS (SELECT {key}, p, h, vs, list_transform(ks, lambda k: list_dot_product(q, k) / sqrt({width}.0)) AS s FROM {t}_h JOIN {t}_k USING ({key}, h))",
            f"{t}_b AS (SELECT {key}, p, h, vs, s, list_max(s) AS top FROM {t}_a)",
            f"{t}_e AS (SELECT {key}, p, h, vs, list_transform(s, lambda y: exp(y - top)) AS e FROM {t}_b)",
            f"{t}_c AS (SELECT {key}, p, h, {each(width, lambda i: f'list_dot_product(e, vs[{i}]) / list_sum(e)')} AS c FROM {t}_e)",
            f"{t}_m AS (SELECT {key}, p, flatten(list(c ORDER BY h)) AS c FROM {t}_c GROUP BY {key}, p)",
            f"{t}_o AS (SELECT {key}, p, c, {linear('c', layer.o, layer.o_bias)} AS o FROM {t}_m)",
            f"{t}_r AS (SELECT {key}, p, {each(h, lambda i: f'v[{i}] + o[{i}]')} AS v FROM {last} JOIN {t}_o USING ({key}, p))",
        ]
        norm(f"{t}_x", f"{t}_r", layer.attention_gamma, layer.attention_beta)
        inner = layer.up.shape[1]
        parts += [
            f"{t}_u AS (SELECT {key}, p, v, {linear('v', layer.up, layer.up_bias)} AS u FROM {t}_x)",
            f"{t}_g AS (SELECT {key}, p, v, {each(inner, lambda i: f'0.5 * u[{i}] * (1 + tanh({v.GELU_SCALE} * (u[{i}] + {v.GELU_CUBE} * u[{i}] * u[{i}] * u[{i}])))')} AS g FROM {t}_u)",
            f"{t}_d AS (SELECT {key}, p, v, {linear('g', layer.down, layer.down_bias)} AS f FROM {t}_g)",
            f"{t}_f AS (SELECT {key}, p, {each(h, lambda i: f'v[{i}] + f[{i}]')} AS v FROM {t}_d)",
        ]
        norm(f"{t}_y", f"{t}_f", layer.output_gamma, layer.output_beta)
        last = f"{t}_y"
    parts.append(f"y AS (SELECT * FROM {last})")
    return _ids_sql() + ", " + ",\n".join(parts) + "\n" + final


def _mean_sql(h: int) -> str:
    """Mean of the tokens and unit length, as table ``z`` (doc_id, chunk_index, v)."""
    mean = ", ".join(f"avg(v[{i}])" for i in range(1, h + 1))
    return (
        f", m AS (SELECT doc_id, chunk_index, [{mean}] AS v FROM y GROUP BY doc_id, chunk_index), "
        "z AS (SELECT doc_id, chunk_index, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM m) "
    )


_CELLS = f"SELECT doc_id, chunk_index, unnest(range(0, len(v))) AS d, {_round('unnest(v)')} AS v FROM "


def _embedded(spark: SparkSession, d: str, m: Embedder, options: EmbedOptions) -> DataFrame:
    """Every chunk of every document, in double precision so that it can be held against SQL; a row for each element."""
    rows = m.doubled().with_embeddings(chunks(spark, d), options=options)
    return quickly_rounded(rows.select("doc_id", "chunk_index", F.posexplode("embedding").alias("d", "v")).withColumn("d", F.col("d").cast("long")))


@query("encoder_forward_tiny", _encoder_sql(tiny(), _mean_sql(8) + _CELLS + "z"))
def encoder_forward_tiny(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(spark, d, tiny(), EmbedOptions(MAX_LENGTH))


@query("encoder_forward_distilled", _encoder_sql(distilled(), " " + _CELLS + "y WHERE p = 0"))
def encoder_forward_distilled(spark: SparkSession, d: str) -> DataFrame:
    """Two layers of the other family; the first token's vector as it is."""
    return _embedded(spark, d, distilled(), EmbedOptions(MAX_LENGTH, "cls", False))


@query("embed_documents", _encoder_sql(model(), _mean_sql(16) + _CELLS + "z"))
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(spark, d, model(), EmbedOptions(MAX_LENGTH))


ASKED = "the end of the nation"


def _search_sql() -> str:
    q = model().doubled().embed([ASKED], EmbedOptions(MAX_LENGTH))[0]
    score = f"list_dot_product(z.v, {_numbers(q)}) / greatest(sqrt(list_dot_product(z.v, z.v)) * {float(np.linalg.norm(q)):.17e}, 1e-12)"
    return _encoder_sql(model(), _mean_sql(16) + f", s AS (SELECT doc_id, chunk_index, text, {score} AS s FROM z JOIN every USING (doc_id, chunk_index)) SELECT doc_id, chunk_index, {_round('s')} AS score, text FROM s ORDER BY s DESC, doc_id, chunk_index LIMIT {TOP}")


@query("semantic_search", _search_sql())
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """The chunks nearest to one text."""
    m = model().doubled()
    rows = m.with_embeddings(chunks(spark, d), options=EmbedOptions(MAX_LENGTH))
    vector = m.embed([ASKED], EmbedOptions(MAX_LENGTH))[0]
    return rounded(s.search(rows, np.asarray(vector).tolist(), TOP, ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "score", "text"), "score")


def _named() -> None:
    for name in QUERIES:
        if not re.fullmatch(r"[a-z0-9_]+", name):
            raise ValueError(f"query name {name!r}")


_named()
