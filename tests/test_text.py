import random

import pytest
from pyspark.sql import functions as F

from embervane.errors import ConfigError, InvalidInput, TokenizerError
from embervane.functions import text as t
from embervane.operators import tokenizer as tk

SMALL = "[PAD] [UNK] [CLS] [SEP] [MASK] hello world un ##aff ##able rust ##ing ##s the a , . ! ?".split()
ODD = [
    "Hello, World!", "it's a test-case.", "café résumé naïve", "über Ärger Zürich", "我爱Rust", "hello\x00world\x01test", "a​b�c", "a b",
    "Hello世界, это тест!", "", "   ", "한국어 텍스트", "が ぎ パ", "İstanbul ΟΔΟΣ", "¿Qué? «sí»", "a b\u0085c", "soft­hyphen", "हिन्दी ज़", "🙂 𠀀𠀁", "x" * 200, "x" * 201, "é" * 100, "é" * 101,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")


@pytest.mark.parametrize("lower", [True, False])
def test_pre_tokenize_equals_specification(spark, lower):
    rng = random.Random(3)
    signs = "aB cé.,!?'’“-_\t\n\r\x00\x7f​﻿ 　 世界한が゙ßİΣ¿«🙂́᪰𠀀ﬁⅧ"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    got = {r.i: r.w for r in frame(spark, texts).select("i", t.pre_tokenize(F.col("text"), lower).alias("w")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == tk.pre_tokenize_str(x, lower), repr(x)


def test_pre_tokenize_of_latin_texts(spark):
    """Texts below U+0300 take another way; every sign of it, alone and among others."""
    rng = random.Random(4)
    texts = [chr(c) for c in range(0x300)] + ["".join(chr(rng.randrange(0x300)) for _ in range(30)) for _ in range(200)] + [f"a{chr(c)}b" for c in range(0x80, 0x300)]
    for lower in (True, False):
        got = {r.i: r.w for r in frame(spark, texts).select("i", t.pre_tokenize(F.col("text"), lower).alias("w")).collect()}
        for i, x in enumerate(texts):
            assert got[i] == tk.pre_tokenize_str(x, lower), repr(x)


def test_pre_tokenize_known_cases(spark):
    expected = {
        "Hello, World!": ["hello", ",", "world", "!"], "it's a test-case.": ["it", "'", "s", "a", "test", "-", "case", "."],
        "café résumé naïve": ["cafe", "resume", "naive"], "我爱Rust": ["我", "爱", "rust"], "hello\x00world\x01test": ["helloworldtest"], "": [],
        "[CLS]": ["[", "cls", "]"], "¿Qué?": ["¿que", "?"],
    }
    got = frame(spark, list(expected)).select("text", t.pre_tokenize(F.col("text")).alias("w")).collect()
    assert {r.text: r.w for r in got} == expected


def test_word_pieces(spark):
    v = tk.Vocab(SMALL)
    assert v.pieces("unaffable") == ["un", "##aff", "##able"] and v.pieces("xyzzy") == ["[UNK]"] and v.pieces("") == []
    assert v.pieces("é" * 101) == ["[UNK]"]
    words = ["unaffable", "xyzzy", "", "rusting", "rusts", "hellos", "unun", "the", "x" * 201, "un"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    native = [r[0] for r in df.select(tk.word_pieces_native(F.col("w"), v)).collect()]
    kernel = [r[0] for r in df.select(tk.word_pieces(F.array("w"), v, spark)).collect()]
    assert native == kernel == [v.pieces(w) for w in words]


def test_encode(spark):
    v = tk.Vocab(SMALL)
    df = frame(spark, ["Hello World", "Hello World Rust", "", None])
    ten = [r[0] for r in df.select(tk.encode(F.col("text"), v, spark, 10)).collect()]
    assert ten[0].input_ids == [2, 5, 6, 3, 0, 0, 0, 0, 0, 0] and ten[0].attention_mask == [1, 1, 1, 1] + [0] * 6 and ten[0].token_type_ids == [0] * 10
    assert ten[2].input_ids[:3] == [2, 3, 0] and ten[3] is None
    four = [r[0] for r in df.select(tk.encode(F.col("text"), v, spark, 4)).collect()]
    assert four[1].input_ids == [2, 5, 6, 3]
    two = [r[0] for r in df.select(tk.encode(F.col("text"), v, spark, 2)).collect()]
    assert two[1].input_ids == [2, 3]
    with pytest.raises(InvalidInput):
        tk.encode(F.col("text"), v, spark, 1)


def test_vocab(spark):
    v = tk.Vocab.parse("[PAD]\r\n[UNK]\n[CLS]\n[SEP]\nx\nx\n")
    assert v.token_id("x") == 5 and v.token_id("nothing") == 1 and v.token(4) == "x" and v.token(9) is None and "x" in v
    with pytest.raises(TokenizerError):
        tk.Vocab(["a"])
    df = spark.createDataFrame([("x",), ("y",), (None,)], "token string")
    assert sorted((r.token or "", r.token_id) for r in tk.lookup(df, v).collect()) == [("", 1), ("x", 5), ("y", 1)]


def loop_chunks(s, size, overlap):
    """Plain loop: windows over code points until one reaches the end."""
    white = "".join(chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    s = s.strip(white)
    if not s:
        return []
    if len(s) <= size:
        return [s]
    out, at = [], 0
    while at < len(s):
        piece = s[at : at + size].strip(white)
        out += [piece] if piece else []
        if at + size >= len(s):
            break
        at += max(size - overlap, 1)
    return out


@pytest.mark.parametrize("size,overlap", [(1000, 100), (4, 1), (3, 5), (1, 0), (0, 0), (7, 7)])
def test_chunks_equal_a_loop(spark, size, overlap):
    rng = random.Random(size)
    texts = ["a" * 3000, "  ", "hello world", "café 日本語 test", None] + ["".join(rng.choice("ab \n　🙂") for _ in range(rng.randint(0, 30))) for _ in range(150)]
    got = frame(spark, texts).select("text", t.chunk_array(F.col("text"), size, overlap).alias("c")).collect()
    for r in got:
        assert r.c == (None if r.text is None else loop_chunks(r.text, size, overlap)), (r.text, size, overlap)


def test_display(spark):
    df = frame(spark, ["café résumé", "abc", None])
    assert [r[0] for r in df.select(t.truncate_display(F.col("text"), 5)).collect()] == ["café ...", "abc", None]
    assert [r[0] for r in df.select(t.char_prefix(F.col("text"), 0)).collect()] == ["", "", None]


def test_config_error_has_its_field():
    assert ConfigError("f", "m").field == "f"
