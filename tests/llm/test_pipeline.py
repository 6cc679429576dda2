"""The pipeline's stages against brute force."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipe

from embervane.llm import lines, pii, quality
from tests.llm.test_ops import brute_groups

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


MIN_DOCS = 12


def test_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines.line_dedup, "__defaults__", (MIN_DOCS, *lines.line_dedup.__defaults__[1:]))  # this table is small
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == columns, name
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.classify(before, labels).where("keep").collect()}
    assert rows(after).keys() == kept
    before, after = map(rows, seen["line_dedup"])
    holders = {}
    for i, t in before.items():
        for x in {" ".join(x.split()).lower() for x in t.split("\n")}:
            holders.setdefault(x, set()).add(i)
    common = {x: min(h) for x, h in holders.items() if x and len({before[i] for i in h}) > MIN_DOCS}
    left = {i: "\n".join(x for x in t.split("\n") if common.get(" ".join(x.split()).lower(), i) == i) for i, t in before.items()}
    assert common and after == {i: t for i, t in left.items() if t.strip()}
    before, after = map(rows, seen["near_dedup"])
    assert after == {i: t for i, t in before.items() if i not in {a for a, _ in brute_groups(before)}}
    before, after = map(rows, seen["pii"])
    assert before.keys() == after.keys()
    assert all(after[i] == t for i, t in before.items() if not pii.entities(t)) and not any(pii.entities(t) for t in after.values())
    before, placed = rows(seen["packing"][0]), seen["packing"][1].groupBy("doc_id").sum("n_tokens").collect()
    assert {r.doc_id: r[1] for r in placed} == {i: len(t.split()) + 1 for i, t in before.items() if t.split()}
    assert all(r.n_chars == len(r.text) for r in seen["pii"][1].collect())


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipe.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    want = pipe.pack(spark, docs, SF).groupBy("doc_id").sum("n_tokens").collect()
    out = pipe.run(spark, SF)
    assert {tuple(r) for r in out.groupBy("doc_id").sum("n_tokens").collect()} == {tuple(r) for r in want} and want
    assert out.groupBy("bin_id").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= 2048
    assert [n for n, _ in pipe.STAGES] == ["quality", "line_dedup", "near_dedup", "pii", "packing"]


def test_emptied_documents_go(spark):
    rows = [(i, "same line\nother line", "x") for i in range(3)] + [(i, f"same line\nother line\nown {i}", "x") for i in range(3, 150)] + [(200, "", "x")]
    # copies count once, so only the second kind makes the lines common
    out = {r.doc_id: r.text for r in pipe.drop_common_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, had string"), "").collect()}
    assert out == {0: "same line\nother line", 200: ""} | {i: f"own {i}" for i in range(3, 150)}
