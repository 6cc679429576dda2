import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from embervane.errors import InvalidInput, TensorError
from embervane.functions import vectors as v
from embervane.operators import linalg as la
from embervane.operators import pooling, search


def one(spark, column, **vectors):
    names = list(vectors)
    df = spark.createDataFrame([tuple(vectors.values())], ", ".join(f"{n} array<double>" for n in names))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


def cells(spark, m):
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(m) for j, x in enumerate(row)], "i long, j long, v double")


def dense(df):
    rows = df.collect()
    out = np.zeros((max(r.i for r in rows) + 1, max(r.j for r in rows) + 1))
    for r in rows:
        out[r.i, r.j] = r.v
    return out.tolist()


def test_elementwise(spark):
    assert one(spark, v.add, a=[1.0, 2.0], b=[3.0, 4.0]) == [4, 6] and one(spark, v.mul, a=[1.0, 2.0], b=[3.0, 4.0]) == [3, 8]
    assert one(spark, lambda a: v.scale(a, 3), a=[1.0, -2.0]) == [3, -6] and one(spark, lambda a: v.shift(a, 1), a=[1.0, -2.0]) == [2, -1]
    assert one(spark, v.dot, a=[1.0, 2.0], b=[3.0, 4.0]) == 11 and one(spark, v.total, a=[1.0, 2.5]) == 3.5 and one(spark, v.total, a=[]) == 0


def test_softmax(spark):
    out = one(spark, v.softmax, a=[1000.0, 1001.0, 1002.0])
    assert sum(out) == pytest.approx(1) and out[2] == pytest.approx(0.66524096)
    assert one(spark, v.softmax, a=[2.0] * 4) == [0.25] * 4 and one(spark, v.softmax, a=[]) is None


def test_layer_norm(spark):
    assert one(spark, v.layer_norm, a=[5.0, 5.0, 5.0]) == [0, 0, 0]
    x = np.array([1.0, 2.0, 4.0, 9.0])
    want = (x - x.mean()) / np.sqrt(x.var() + 1e-12)
    assert one(spark, v.layer_norm, a=x.tolist()) == pytest.approx(want.tolist())
    assert one(spark, v.layer_norm, a=x.tolist(), g=[2.0] * 4, b=[1.0] * 4) == pytest.approx((want * 2 + 1).tolist())


def test_gelu_and_l2(spark):
    out = one(spark, v.gelu, a=[0.0, 1.0, -1.0])
    assert out == pytest.approx([0, 0.8412, -0.1588], abs=1e-3)
    assert one(spark, v.l2_normalize, a=[3.0, 4.0]) == pytest.approx([0.6, 0.8]) and one(spark, v.l2_normalize, a=[0.0, 0.0]) == [0, 0]


def test_cosine(spark):
    assert one(spark, v.cosine, a=[1.0, 2.0], b=[1.0, 2.0]) == pytest.approx(1) and one(spark, v.cosine, a=[1.0, 0.0], b=[0.0, 1.0]) == 0
    assert one(spark, v.cosine, a=[0.0, 0.0], b=[1.0, 1.0]) == 0


def test_halves(spark):
    codes = np.arange(65536, dtype=np.uint16)
    rows = spark.range(65536).select("id", v.f16_decode(F.col("id").cast("int")).alias("h"), v.bf16_decode(F.col("id").cast("int")).alias("b")).orderBy("id").collect()
    np.testing.assert_array_equal(np.array([r.h for r in rows]), codes.view(np.float16).astype(float))
    np.testing.assert_array_equal(np.array([r.b for r in rows]), (codes.astype(np.uint32) << 16).view(np.float32).astype(float))


def test_blobs(spark):
    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,), ([3.0],)], "v array<float>").coalesce(1)
    assert [r[0] for r in df.select(v.from_blob(v.to_blob(F.col("v")))).collect()] == [[1.5, -2.0], [], None, [3.0]]
    assert [r[0] for r in df.select(v.to_blob(F.col("v"))).collect()] == [np.array([1.5, -2.0], "<f4").tobytes(), b"", None, np.array([3.0], "<f4").tobytes()]
    with pytest.raises(Exception, match="multiple of 4"):
        spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(v.from_blob(F.col("b"))).collect()


def test_matrices(spark):
    a, b = cells(spark, [[1, 2], [3, 4]]), cells(spark, [[5, 6], [7, 8]])
    assert dense(la.matmul(a, b)) == [[19, 22], [43, 50]]
    assert dense(la.transpose(cells(spark, [[1, 2, 3], [4, 5, 6]]))) == [[1, 4], [2, 5], [3, 6]]
    assert dense(la.reshape(cells(spark, [[1, 2, 3], [4, 5, 6]]), 3, 2)) == [[1, 2], [3, 4], [5, 6]]
    assert sorted((r.j, r.v) for r in la.slice_first(a, 1).collect()) == [(0, 3), (1, 4)]
    assert la.stack(a, b).where("k = 1").count() == 4
    bias = spark.createDataFrame([(0, 10.0), (1, 20.0)], "j long, v double")
    assert dense(la.add_bias(a, bias)) == [[11, 22], [13, 24]]
    rows = spark.createDataFrame([(0, 2.0), (1, 3.0)], "i long, v double")
    assert dense(la.mul_broadcast_last(a, rows)) == [[2, 4], [9, 12]] and dense(la.add_broadcast(a, rows, ["i"])) == [[3, 4], [6, 7]]
    assert sorted((r.j, r.v) for r in la.sum_axis(a, 0).collect()) == [(0, 4), (1, 6)]
    with pytest.raises(TensorError):
        la.sum_axis(a, 2)
    with pytest.raises(TensorError):
        la.stack()
    both = [x.withColumn("b", F.lit(k)) for k, x in ((0, cells(spark, [[1, 0], [0, 1]])), (1, cells(spark, [[2, 0], [0, 2]])))]
    right = [b.withColumn("b", F.lit(k)) for k in (0, 1)]
    out = la.batched_matmul(both[0].union(both[1]), right[0].union(right[1]))
    assert dense(out.where("b = 1")) == [[10, 12], [14, 16]]
    e = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "i long, x array<double>")
    assert dense(la.gram(e, "x")) == [[10, 14], [14, 20]]
    assert {r.i: r.vector for r in la.vectors(a).collect()} == {0: [1, 2], 1: [3, 4]}
    place = la.flat_index([F.lit(1), F.lit(2)], [3, 4])
    assert spark.range(1).select(place, la.flat_index([F.lit(3), F.lit(0)], [3, 4])).first()[:] == (6, None)


def test_constructors_and_cells(spark):
    m = la.from_values(spark, [1, 2, 3, 4, 5, 6], 2, 3)
    assert dense(m) == [[1, 2, 3], [4, 5, 6]] and dense(la.ones(spark, 2, 2)) == [[1, 1], [1, 1]] and dense(la.zeros(spark, 1, 2)) == [[0, 0]]
    assert la.full(spark, 0, 3, 1.0).count() == 0 and la.get(m, 1, 2).first()[0] == 6 and la.get(m, 2, 0).count() == 0
    changed = la.set_cell(m, 0, 1, 9)
    assert dense(changed) == [[1, 9, 3], [4, 5, 6]] and la.shape(m).first()[:] == (2, 2, 3, 6)
    same = lambda a, b: la.equal(a, b).first()[0]
    assert same(m, m) and not same(m, changed) and not same(m, la.transpose(m)) and same(m.limit(0), m.limit(0))
    nan = la.full(spark, 1, 1, float("nan"))
    assert not same(nan, nan)
    for wrong in (lambda: la.from_values(spark, [1.0], 2, 2), lambda: la.full(spark, -1, 2, 0.0)):
        with pytest.raises(TensorError):
            wrong()


def test_pooling(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 4.0], 1), (1, 2, [100.0, 200.0], 0), (2, 0, [7.0, 8.0], 0)], "t int, p int, x array<double>, m int")
    got = {(r.t, r.d): r.v for r in pooling.mean_pool(df, "t", "x", "m").collect()}
    assert got == {(1, 0): 2, (1, 1): 3, (2, 0): 0, (2, 1): 0}
    assert {r.t: r.x for r in pooling.cls_pool(df, "t", "p", "x").collect()} == {1: [1, 2], 2: [7, 8]}


def test_search(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0, 1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    assert [r.id for r in search.search(df, [1.0, 0.0], 3, ["id"]).collect()] == [0, 2, 1]
    assert [r.id for r in search.search(df, [1.0, 1.0, 0.0], 9, ["id"]).collect()] == [3]
    assert search.search(df, [1.0, 0.0], 0, ["id"]).count() == 0
    with pytest.raises(InvalidInput):
        search.search(df, [1.0], -1, ["id"])


def test_search_plans_a_top_k(spark):
    df = spark.range(100).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    plan = search.search(df, [1.0, 0.0], 3, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


@pytest.mark.parametrize("tile_bytes", [200, 10**6])
def test_top_k_join_equals_brute_force(spark, tile_bytes):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(40, 3)), 1)
    x[7], x[9] = x[3], x[3]  # ties
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in search.top_k_join(df.withColumnRenamed("id", "query_id"), df, 4, tile_bytes).collect()}
    n = np.linalg.norm(x, axis=1)
    score = np.round(x @ x.T / np.maximum(n[:, None] * n, 1e-12), 9)
    for q in range(40):
        assert [got[q, k] for k in range(1, 5)] == sorted(range(40), key=lambda i: (-score[q, i], i))[:4]
    others = {(r.query_id, r["rank"]): r.id for r in search.top_k_join(df.withColumnRenamed("id", "query_id"), df, 2, tile_bytes, self_pairs=False).collect()}
    for q in range(40):
        assert [others[q, k] for k in (1, 2)] == sorted(set(range(40)) - {q}, key=lambda i: (-score[q, i], i))[:2]
    every = {(r.query_id, r.id): r.score for r in search.score_join(df.withColumnRenamed("id", "query_id"), df, tile_bytes).collect()}
    assert len(every) == 1600 and all(abs(every[a, b] - score[a, b]) < 1e-8 for a, b in every)


def test_score_join_sends_pieces():
    """Not all pairs of a tile are held at once, and none is lost; vectors without elements are pairs, too."""
    rng = np.random.default_rng(6)
    for n, m, dim in ((1000, 1500, 4), (3, 2, 0), (2, 250_000, 1)):
        x, y = rng.normal(size=(n, dim)), rng.normal(size=(m, dim))
        block = lambda v: search._block(pa.table({"id": np.arange(len(v)), "v": pa.FixedSizeListArray.from_arrays(v.ravel(), dim).cast(pa.list_(pa.float64())) if dim else pa.array([[]] * len(v), pa.list_(pa.float64()))}))
        pieces = list(search._pairs(block(x), block(y)))
        assert max(len(q) for q, _, _ in pieces) <= max(m, search.BATCH_ROWS)
        q, c, s = map(np.concatenate, zip(*pieces))
        assert len(np.unique(q * m + c)) == n * m
        length = np.maximum(np.linalg.norm(x, axis=1)[q] * np.linalg.norm(y, axis=1)[c], 1e-12)
        np.testing.assert_allclose(s, (x[q] * y[c]).sum(1) / length, atol=1e-12)


@pytest.mark.parametrize("self_pairs", [True, False])
def test_the_quick_top_k_leaves_none_out(self_pairs):
    """Copies, near copies, ties, zero vectors: the same as brute force, with few pairs scored in double precision."""
    rng = np.random.default_rng(8)
    y = rng.normal(size=(5000, 16))
    y[100:140], y[4000:4003], y[7], y[4999] = y[99], y[5], 0, 0
    y[3000:3500] = y[0] + rng.normal(size=(500, 16)) * 1e-7
    ids = np.arange(5000) * 3
    block = lambda part: (ids[part], y[part], np.linalg.norm(y[part], axis=1))
    q, c, s = map(np.concatenate, zip(*search._near(block(slice(0, 600)), block(slice(None)), 5, self_pairs)))
    n = np.linalg.norm(y, axis=1)
    for i in range(600):
        score = np.round((y @ y[i]) / np.maximum(n * n[i], 1e-12), 9)
        if not self_pairs:
            score[i] = -9
        order = np.lexsort((ids, -score))[:5]
        assert c[q == ids[i]].tolist() == ids[order].tolist() and np.abs(s[q == ids[i]] - score[order]).max() < 1e-8
    assert search._near(block(slice(0, 600)), (ids, y * 1e-13, n * 1e-13), 5, True) is None and search._near(block(slice(0, 9)), block(slice(0, 9)), 5, True) is None


def test_a_tile_is_a_task(spark):
    """Pairs are dealt out by ``tile_rows``, whatever the bytes: the longest task doesn't grow with the table."""
    df = spark.range(1000).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    out = search.score_join(df.where("id % 10 = 0").withColumnRenamed("id", "query_id"), df, tile_rows=100)
    assert out.rdd.getNumPartitions() == 10 and out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert out.count() == 100_000


def test_quick_rounding(spark):
    from embervane.plans import queries

    x = [0.1234565, -0.1234565, 0.5e-6, -0.5e-6, 2.5e-6, 1.0, -0.0, 1e300, 0.12345649999999]
    got = [r.v for r in queries.quickly_rounded(spark.createDataFrame([(a,) for a in x], "v double").coalesce(1)).collect()]
    assert got == [math.copysign(math.floor(abs(a * 1e6) + 0.5) / 1e6, a) if abs(a) < 1e9 else a for a in x]


def test_math_is_double():
    assert math.isclose(v.GELU_SCALE, math.sqrt(2 / math.pi), rel_tol=1e-6)
