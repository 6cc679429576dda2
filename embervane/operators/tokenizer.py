"""Vocabulary, word pieces and encodings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInput, SourceError, TokenizerError
from ..functions.text import pre_tokenize, strip_accents_str

CLS, SEP, PAD, UNK, MASK = "[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]"
MAX_WORD_BYTES = 200
_MEMO = 500_000


class Vocab:
    """Tokens by line number; a repeated token has its last line's id."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        for name in (CLS, SEP, PAD, UNK):
            if name not in self.ids:
                raise TokenizerError(f"the vocabulary has no {name}")
        self.cls_id, self.sep_id, self.pad_id, self.unk_id = (self.ids[x] for x in (CLS, SEP, PAD, UNK))
        self.longest = max(map(len, tokens))

    @classmethod
    def parse(cls, text: str) -> Vocab:
        lines = text.split("\n")
        if lines and lines[-1] == "":
            lines.pop()
        return cls([line.removesuffix("\r") for line in lines])

    @classmethod
    def read(cls, path: str) -> Vocab:
        try:
            with open(path, encoding="utf-8", newline="") as f:
                return cls.parse(f.read())
        except OSError as e:
            raise SourceError(f"{path}: {e}") from e

    def __len__(self) -> int:
        return len(self.ids)

    def __contains__(self, token: str) -> bool:
        return token in self.ids

    def token_id(self, token: str) -> int:
        return self.ids.get(token, self.unk_id)

    def token(self, i: int) -> str | None:
        return self.tokens[i] if 0 <= i < len(self.tokens) else None

    def table(self, spark: SparkSession) -> DataFrame:
        """(token, id)."""
        return spark.createDataFrame(list(self.ids.items()), "token string, id int")

    def pieces(self, word: str) -> list[str]:
        """Longest match first from the left; [UNK] if any part has no match or the word is over 200 bytes."""
        if not word:
            return []
        if len(word.encode()) > MAX_WORD_BYTES:
            return [UNK]
        out, at, ids = [], 0, self.ids
        while at < len(word):
            mark = "##" if at else ""
            for end in range(min(len(word), at + self.longest), at, -1):
                if (piece := mark + word[at:end]) in ids:
                    break
            else:
                return [UNK]
            out.append(piece)
            at = end
        return out


def word_pieces(words: Column, vocab: Vocab, spark: SparkSession) -> Column:
    """array<string> of word pieces of an array of words; each distinct word is cut once by each worker."""
    shared = spark.sparkContext.broadcast(vocab)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, memo = shared.value, {}
        names = pa.array(own.tokens, pa.string())
        for lists in batches:
            ends, values, mask = _pieces(lists, own, memo)
            yield pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(values)), mask=mask)

    return cut(words)


def _pieces(lists: pa.Array, vocab: Vocab, memo: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
    """(row ends, piece ids, nulls) of lists of words: the batch's distinct words are cut once each; then one gather."""
    flat = lists.flatten().dictionary_encode()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(memo) > _MEMO:
        memo.clear()
    cut = []
    for word in flat.dictionary.to_pylist():
        if word not in memo:
            memo[word] = [vocab.ids[p] for p in vocab.pieces(word)]
        cut.append(memo[word])
    count = np.array([len(c) for c in cut], np.int64)
    values = np.array([i for c in cut for i in c], np.int32)
    which = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = count[which] if len(which) else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    source = np.repeat((np.cumsum(count) - count)[which] - at[:-1], n) + np.arange(at[-1]) if len(which) else np.zeros(0, np.int64)
    ends = at[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    return ends, values[source], lists.is_null() if lists.null_count else None


def encode(text: Column, vocab: Vocab, spark: SparkSession, max_length: int = 128, pad: bool = True, do_lower_case: bool = True) -> Column:
    """struct(input_ids, attention_mask, token_type_ids): [CLS] pieces [SEP], cut and padded to ``max_length``.

    A word has at least one piece, so words beyond ``max_length - 2`` are cut off before they are looked at.
    """
    if max_length < 2:
        raise InvalidInput("max_length must be at least 2")
    words = pre_tokenize(text, do_lower_case)
    ids = piece_ids(F.slice(words, 1, max_length - 2) if max_length > 2 else F.slice(words, 1, 0), vocab, spark)
    body = F.slice(ids, 1, max_length - 2) if max_length > 2 else F.slice(ids, 1, 0)
    whole = F.concat(F.array(F.lit(vocab.cls_id)), body, F.array(F.lit(vocab.sep_id)))
    n = F.size(body) + 2
    room = (F.lit(max_length) - n) if pad else F.lit(0)
    return F.when(
        text.isNotNull(),
        F.struct(
            F.concat(whole, F.array_repeat(F.lit(vocab.pad_id), room)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), room)).alias("attention_mask"),
            F.array_repeat(F.lit(0), n + room).alias("token_type_ids"),
        ),
    )


def piece_ids(words: Column, vocab: Vocab, spark: SparkSession) -> Column:
    """array<int> of word-piece ids of an array of words."""
    shared = spark.sparkContext.broadcast(vocab)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, memo = shared.value, {}
        for lists in batches:
            ends, values, mask = _pieces(lists, own, memo)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=mask)

    return look(words)


def piece_patterns(vocab: Vocab) -> tuple[str, str]:
    """(pattern of first pieces, pattern of continuations) of a small vocabulary, longest alternatives first."""
    heads = sorted((t for t in vocab.ids if t and not t.startswith("##")), key=lambda t: (-len(t), t))
    tails = sorted((t[2:] for t in vocab.ids if t.startswith("##") and len(t) > 2), key=lambda t: (-len(t), t))
    return "|".join(map(re.escape, heads)), "|".join(map(re.escape, tails)) or r"[^\s\S]"


def word_pieces_native(word: Column, vocab: Vocab) -> Column:
    """array<string> of one word's pieces inside the JVM, for vocabularies small enough to be a pattern."""
    heads, tails = piece_patterns(vocab)
    head = F.regexp_extract(word, f"^(?:{heads})", 0)
    rest = F.substring(word, F.char_length(head) + 1, F.char_length(word))
    more = F.regexp_extract_all(rest, F.lit(tails), F.lit(0))
    whole = (head != "") & (F.concat_ws("", more) == rest) & (F.octet_length(word) <= MAX_WORD_BYTES)
    cut = F.concat(F.array(head), F.transform(more, lambda p: F.concat(F.lit("##"), p)))
    return F.when(word == "", F.array().cast("array<string>")).when(whole, cut).when(word.isNotNull(), F.array(F.lit(UNK)))


def lookup(tokens: DataFrame, vocab: Vocab, column: str = "token") -> DataFrame:
    """``tokens`` with ``token_id``; unknown tokens have the id of [UNK]. The vocabulary is a fixed file: a broadcast join."""
    table = vocab.table(tokens.sparkSession).withColumnRenamed("token", column)
    return tokens.join(F.broadcast(table), column, "left").withColumn("token_id", F.coalesce("id", F.lit(vocab.unk_id))).drop("id")


def pre_tokenize_str(text: str, do_lower_case: bool = True) -> list[str]:
    """``pre_tokenize`` of one string in plain Python: the specification that the Column form is tested against."""
    from ..functions import text as t

    def members(spec: str) -> str:
        return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), spec)

    clean = re.sub(f"[{members(t.CONTROL)}]", "", text)
    clean = re.sub(f"[{members(t.BLANK)}]", " ", clean)
    clean = re.sub(f"([{members(t.IDEOGRAPH)}])", r" \1 ", clean)
    if do_lower_case:
        clean = strip_accents_str(clean.lower())
    punctuation, white = members(t.PUNCTUATION), members(t.WHITE)
    return re.findall(f"[{punctuation}]|[^{punctuation}{white}]+", clean)
