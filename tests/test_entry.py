import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from embervane.plans import queries as q
from embervane.sources import files

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(q.QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == q.TOP


def test_narrow_plans_have_no_shuffle(spark):
    for name in ("chunk_documents", "chunk_counts", "pre_tokenize", "encode_ids", "embed_documents", "softmax", "l2_normalize", "edge_request"):
        text = plan(q.QUERIES[name](spark, SF))
        # small tables are spread over the cores before anything else; that is all that moves
        assert text.count("Exchange ") == text.count("Exchange RoundRobinPartitioning") <= 1, name


def test_large_tables_are_not_spread(spark):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    assert "RoundRobin" in plan(files.spread(small)) and "Exchange" not in plan(files.spread(small, least_bytes=1))


def test_the_model_runs_once(spark):
    for name in ("semantic_search", "edge_request"):
        text = plan(q.QUERIES[name](spark, SF))
        assert len(re.findall(r"ArrowEvalPython \[run\(|ArrowEvalPython \[look\(", text)) <= 2 and text.count("[run(") == 1, name


def test_scans_read_only_what_they_need(spark):
    text = plan(q.QUERIES["chunk_counts"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,7)]" in plan(q.QUERIES["slice_first"](spark, SF))


def test_works_without_the_corpus_operators(tmp_path):
    """A copy of the repository without them still imports and registers the rest; workers find the package from any folder."""
    for name in ("embervane", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "embervane/llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *e.queries())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": "/root"}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(q.QUERIES) and int(out[1]) == len(q.SQL) and "pipeline" not in out
