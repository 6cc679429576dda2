"""What the operators' final plans shuffle."""

from embervane.llm import bpe, fingerprint, lines, packing, quality, toxicity

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_exchanges(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    assert exchanges(bpe.round_trip(docs)) == 0
    assert exchanges(toxicity.classify(docs, labels)) == 0
    assert exchanges(quality.filter_quality(docs, labels)) == 0
    assert exchanges(lines.line_dedup(docs)) == 0  # lines were counted on hashes; texts stay where they are
    assert exchanges(packing.pack(docs)) == 1
    text = fingerprint.fingerprints(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "canon" not in text  # rows meet by digest; no text is in the plan


def test_decoded_ids_stay_in_python(spark):
    """One Python step for texts and back, with the same texts as two."""
    from __spark_entry__ import queries

    text = queries()["bpe_decoded"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython [") == 1
    df = spark.createDataFrame([(0, None), (1, ""), (2, "l'été, 漢字 🙂\n\t x"), (3, "a" * 5000)], "doc_id int, text string").coalesce(1)
    assert [r.t for r in df.select(bpe.recoder(df)("text").alias("t")).collect()] == [r.text for r in df.collect()]
