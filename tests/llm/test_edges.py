"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing column names, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

from embervane.llm import bpe, embdedup, fingerprint, lines, minhash, packing, pii, quality, suffix, toxicity

CLASH = "key sig root rank h n at lead doc digest canon k shard block tile_a term class value low hinted p rest drop row text_ group_id copies keep first d left had clean __ev_drop __ev_clean __ev_key __key __rank __digest __k __d __left __clean __had".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in [*CLASH, "a.b"])
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
SAME = " ".join(f"tok{i}" for i in range(80))


def documents(spark, rows):
    full = [(i, t, lang, None, None, *["x"] * (len(CLASH) + 1)) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA)


ROWS = [
    (1, SAME, "en"),
    (1, SAME, "en"),  # a repeated row
    (2, None, "en"),
    (3, "", None),
    (4, "   \n\t ", "de"),
    (None, "nobody knows this one\nat all", None),
    (None, None, None),
    (5, LONG, "en"),
    (6, "x" * 300_000, "fr"),
    (7, "mail me: a.b@mail.example.com or +1 (212) 555-0101", "en"),
    (8, "short", "en"),
    (9, "Ünïcödé ﬁne  text 日本語 🙂", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(docs, empty, labels):
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == len(ROWS) and not any(r.toxic for r in out)  # too few labels: nothing is toxic
    assert toxicity.classify(empty, labels).count() == 0
    assert toxicity.classify(docs, labels.limit(0)).where("toxic").count() == 0


def test_bpe(docs, empty):
    out = bpe.round_trip(docs).collect()
    assert len(out) == len(ROWS) and all(r.lossless for r in out)
    by = {r.doc_id: r for r in out}
    assert by[2].token_ids is None and by[2].n_tokens is None and by[3].token_ids == []
    assert bpe.round_trip(empty).count() == 0


def test_bpe_rejects_unknown_ids(spark):
    df = spark.createDataFrame([([10**7],)], "ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        df.select(bpe.decoder(df)(F.col("ids"))).collect()


def test_bpe_decodes_broken_bytes(spark):
    ranks = bpe.read_ranks()
    df = spark.createDataFrame([([ranks[b"\xff"], ranks[b"a"]],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(bpe.decoder(df)(F.col("ids"))).collect()] == ["�a", None, ""]


def test_embeddings(spark):
    rows = [
        (1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [0.0, 0.0], "x"), (4, None, "x"), (5, [], "x"),
        (None, [1.0, 0.0], "x"), (6, [float("nan"), 1.0], "x"), (7, [1.0, 0.0, 0.0], "x"), (8, [1.0, None], "x"), (9, [-1.0, 0.0], "x"), (10, [1e-30, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    out = {r.vec_id: (r.class_id, r.n_links) for r in embdedup.links(df).collect()}
    assert out == {1: (1, 2), 2: (1, 2), 10: (1, 2)} | {i: (i, 0) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert embdedup.links(df.limit(0)).count() == 0
    # an id with two vectors is in the class of both
    two = spark.createDataFrame([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 0.01]), (8, [0.01, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.class_id, r.n_links) for r in embdedup.links(two).collect()} == {5: (5, 2), 7: (5, 1), 8: (5, 1)}


def test_pii(docs, empty):
    out = {(r.doc_id, r.text) for r in pii.sanitised(docs).select("doc_id", "text").collect()}
    same = {(i, t) for i, t, _ in ROWS if i != 7}
    assert out == same | {(7, "mail me: [EMAIL] or [PHONE]")}
    assert pii.sanitised(docs).columns == docs.columns
    assert pii.sanitised(empty).count() == 0 and pii.report(empty).count() == 0


def test_suffix(docs, empty):
    out = suffix.repeated_passages(docs).collect()
    # the repeated row is one doc_id twice: two rows hold the passage
    assert sorted((r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in out) == [(1, 0, 80, 1)] * 2
    assert suffix.repeated_passages(empty).count() == 0


def test_quality(docs, empty, labels):
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert not out[2].keep and not out[3].keep and not out[4].keep and out[2].quality_score == 0
    assert quality.classify(empty, labels).count() == 0
    kept = quality.filter_quality(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == sum(bool(t and t.strip()) for _, t, _ in ROWS)


def test_fingerprints(docs, empty):
    out = fingerprint.fingerprints(docs).collect()
    assert len(out) == len(ROWS)
    ones = [r for r in out if r.doc_id == 1]
    assert [r.copies for r in ones] == [2, 2] and sum(r.keep for r in ones) == 1
    assert all(r.keep and r.copies == 1 and r.fingerprint is None for r in out if r.doc_id == 2)
    blank = {r.doc_id: r for r in out if r.doc_id in (3, 4)}
    assert blank[3].group_id == blank[4].group_id == 3 and blank[3].keep and not blank[4].keep
    assert fingerprint.fingerprints(empty).count() == 0


def test_lines(docs, empty):
    out = lines.line_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()))) == sorted(repr((i, t)) for i, t, _ in ROWS)
    assert lines.line_dedup(empty).count() == 0


def test_packing(docs, empty):
    out = packing.pack(docs, capacity=64).collect()
    assert {r.doc_id for r in out} == {1, None, 5, 6, 7, 8, 9}
    assert sum(r.n_tokens for r in out if r.doc_id == 5) == 60_001
    assert packing.pack(empty).count() == 0


def test_extra_columns_pass(docs):
    """Columns that have the operators' own names keep their values."""
    for out in (lines.line_dedup(docs, 0), pii.sanitised(docs), minhash.near_dedup(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and rows and all(r[c] == "x" for r in rows for c in [*CLASH, "a.b"])


def test_minhash(docs, empty):
    out = minhash.duplicates(docs).collect()
    assert [(r.doc_id, r.duplicate_of, r.group_size) for r in out] == [(1, 1, 2)]
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    assert minhash.near_dedup(empty).count() == 0 and minhash.duplicates(empty).count() == 0


def test_pii_key_without_digits(spark):
    """A key of capitals alone, on a line without a digit, @, = or :."""
    key = "AKIA" + "QWERTYUIOPASDFGH"
    text = f"first line\nthe key {key} was lost\nlast line"
    assert pii.entities(text) == [(text.index(key), text.index(key) + 20, "SECRET")]
    out = pii.report(spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string"))
    assert {r.doc_id: (r.text, r.n_entities) for r in out.collect()} == {1: (text.replace(key, "[SECRET]"), 1), 2: ("nothing here", 0)}


def test_pii_hint_finds_all_that_the_patterns_find():
    rng = random.Random(12)
    parts = ["AKIA", "ASIA", "QWERTYUIOPASDFGH", "+", "٣٤", "+٤٩ ٣٠ ١٢٣٤ ٥٦٧٨", "a@b.cd", "token", "=", ":", "abcdefgh", "12", "-", ".", " ", " ", "\n", "\n", "é", "(212) 555-0101", "DE89 3704 0044 0532 0130 00", "10.0.0.1"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        every = []
        for k, line in enumerate(text.split("\n")):
            at, base = 0, sum(len(x) + 1 for x in text.split("\n")[:k])
            while m := pii._ANY.search(line, at):
                if pii._checked(m.lastgroup, m[0]):
                    every.append((base + m.start(), base + m.end(), m.lastgroup))
                    at = m.end()
                else:
                    at = m.start() + 1
        assert pii.entities(text) == every, text


def test_pii_digits_of_any_script(spark):
    texts = ["call +٤٩ ٣٠ ١٢٣٤ ٥٦٧٨ now", "call +\U0001e4f4\U0001e4f9 \U0001e4f3\U0001e4f0 \U0001e4f1\U0001e4f2\U0001e4f3\U0001e4f4 now", "nothing é"]
    out = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {0: "call [PHONE] now", 1: "call [PHONE] now", 2: "nothing é"}


def test_pii_case_is_told_apart_alike():
    for word in ("ΑΣ", "İstanbul", "STRASSE", "Éa"):
        assert pii.low(f"{word}.Βx {word} y").split(" ")[1] == pii.low(word) and pii.low(f"{word}.Βx").startswith(pii.low(word))


def test_stages_of_the_pipeline(docs, empty, labels, spark, tmp_path):
    import corpus_pipeline as pipe

    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    now, none = docs, empty
    for name, stage in pipe.STAGES:
        now, none = stage(spark, now, str(tmp_path)), stage(spark, none, str(tmp_path))
        assert none.count() == 0, name
        if name != "packing":
            assert now.columns == docs.columns, name
            now.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
            assert all(r[c] == "x" for r in now.collect() for c in CLASH), name
    assert {r.doc_id for r in now.collect()} == {1, None, 5, 6, 7, 8, 9}  # blank texts went first, of the repeated row one stayed
    rest = spark.read.parquet(str(tmp_path / "near_dedup"))
    assert rest.where("doc_id = 1").count() == 1


def test_repeated_rows_are_trained_on_once(spark):
    texts = [f"word{i} " * 5 for i in range(30)]
    many = spark.createDataFrame([(i % 30, texts[i % 30]) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = quality.train(many, labels), quality.train(once, labels)
    assert (a.weight == b.weight).all() and a.threshold == b.threshold
    assert toxicity.train(many, labels) == toxicity.train(once, labels)
