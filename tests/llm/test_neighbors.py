import numpy as np
from pyspark.sql import functions as F

from termloom.llm.neighbors import hilbert_keys, nearest, usable


def test_hilbert_curve_is_continuous():
    cells = np.array([[i, j] for i in range(16) for j in range(16)])
    order = cells[np.argsort(hilbert_keys(cells, 4))]
    assert len(set(hilbert_keys(cells, 4))) == 256
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_usable(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, None, [1.0, 1.0]), (4, None, [1.0, 1.0]), (5, "b", [nan, 1.0]), (6, "c", [inf, 1.0]), (7, "d", [0.0, 0.0]), (8, "e", [1.0]), (9, "f", None), (10, "g", [None, 1.0])]
    df = spark.createDataFrame(rows, "row_id long, doc_id string, vector array<float>").withColumn("v", F.lit(0)).withColumn("own", F.lit(0))
    assert sorted(r.row_id for r in usable(df, "row_id", "vector", 2, "doc_id").collect()) == [1, 3, 4]
    assert nearest(usable(df.limit(0), "row_id", "vector", 2, "doc_id")).count() == 0
    assert nearest(usable(df.where("row_id = 3"), "row_id", "vector", 2, "doc_id")).count() == 0
    assert {(r.row_id, r.neighbor, r.rank) for r in nearest(usable(df, "row_id", "vector", 2, "doc_id"), 1).collect()} == {(1, 3, 1), (3, 4, 1), (4, 3, 1)}


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((300, 32))
    x = (centres[:, None] + 0.3 * rng.standard_normal((300, 10, 32))).reshape(-1, 32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, v array<float>")
    got = {}
    for r in nearest(df, 5).collect():
        got.setdefault(r.row_id, []).append(r.neighbor)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :5]
    assert all(len(g) == 5 for g in got.values()) and len(got) == len(x)
    assert np.mean([len(set(t) & set(got[i])) / 5 for i, t in enumerate(true)]) >= 0.9


def test_all_the_same(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1500)], "row_id long, v array<float>")
    got = nearest(df, 5)
    assert got.count() == 7500 and got.where("abs(score - 1) > 1e-9 or row_id = neighbor").count() == 0


def test_large_groups_of_one_direction(spark):
    rng = np.random.default_rng(5)
    few = rng.integers(-9, 10, (4, 8)).astype(float)
    few[:, 0] = 1.0
    which = rng.permutation(np.repeat([0, 1, 2, 3], [1500, 1000, 4, 1]))
    x = few[which] * rng.integers(1, 4, len(which))[:, None]
    got = {}
    for r in nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, v array<float>"), 5).collect():
        got.setdefault(r.row_id, {})[r.rank] = r.neighbor
    u = few / np.linalg.norm(few, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, 2.0)
    by_group = [np.lexsort((np.arange(len(which)), -sims[g][which])) for g in range(4)]
    for i, g in enumerate(which):
        assert [got[i][p] for p in range(1, 6)] == [int(j) for j in by_group[g] if j != i][:5]
