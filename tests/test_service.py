import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import service as S


def labels(spark):
    rows = [(1, "C0000001", "renal cyst", "SNO", "PT", "Y", "N"), (2, "C0000001", "cyst of kidney", "MSH", "SY", "N", "N"), (3, "C0000002", "cyst", "MSH", "PT", "Y", "N"), (4, "C0000003", "old cyst", "MSH", "PT", "Y", "O"), (5, "C0000004", None, "MSH", "PT", "Y", "N")]
    return spark.createDataFrame(rows, "row_id long, cui string, label string, sab string, tty string, ispref string, suppress string")


def test_requests(spark):
    d = labels(spark)
    ask = lambda **k: [(r.place, r.row_id) for r in S.answer(d, S.Request(**k)).orderBy("place").collect()]
    assert ask(text="cyst") == [(1, 3), (2, 1)]
    assert ask(text="cyst", obsolete=True) == [(1, 3), (2, 4), (3, 1)]
    assert ask(text="cyst", size=1, page=2) == [(2, 1)]
    assert ask(text="cyst", sources=["SNOMEDCT_US"]) == [(1, 1)]
    assert ask(text="cyst", returns="code") == [(1, 3), (2, 1), (3, 2)]
    assert ask(text="c0000001") == [(1, 1)] and ask(text="nothing") == []
    for bad in ({"mode": "fuzzy"}, {"page": 0}, {"returns": "x"}):
        with pytest.raises(ValueError):
            S.answer(d, S.Request(text="a", **bad))


def test_profiles_modes_policies(spark):
    t = spark.createDataFrame([("a", "T1"), ("a", "T2"), ("b", "T9"), ("c", None)], "cui string, tui string")
    assert {(r.cui, r.group) for r in S.profile(t, {"drug": ["T2"], "disorder": ["T1"]}).collect()} == {("a", "drug"), ("b", "other"), ("c", "other")}
    h = spark.createDataFrame([(0.5,), (0.7,), (None,)], "relevance double")
    assert S.by_mode(h, "balanced").count() == 1 and S.by_mode(h, "comprehensive").count() == 2
    p = spark.createDataFrame([("s", 1), ("r", 2), ("x", 3)], "source string, n int")
    pol = spark.createDataFrame([("s", "open", False), ("r", "own", True)], "source string, license string, restricted boolean")
    assert [r.n for r in S.allowed_pages(p, pol).collect()] == [1] and S.allowed_pages(p, pol, True).count() == 2


def test_confidence_and_rank(spark):
    c = lambda a, b, n: spark.range(1).select(S.interval_confidence(F.lit(a), F.lit(b), F.lit(n)).alias("x")).first().x
    assert c(1.2, 1.4, 1000) > c(0.9, 1.6, 1000) > c(0.5, 4.0, 10) and c(-1.0, 2.0, 5) is None
    r = spark.createDataFrame([(1, "a", 1, 0.0), (1, "b", 2, 2.0), (1, "c", 3, None)], "query long, cui string, place int, f double")
    assert [(x.cui, x.ml_rank) for x in S.linear_rank(r, {"f": 1.0}).orderBy("ml_rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]


def test_files_and_hash_vectors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    f = S.file_fingerprints(spark, str(tmp_path)).first()
    assert (f.name, f.size, f.md5) == ("a.txt", 3, "900150983cd24fb0d6963f7d28e17f72")
    d = spark.createDataFrame([(1, "renal cyst"), (2, "Renal  CYST"), (3, None), (4, "cyst")], "id long, t string")
    v = {r.id: np.array(r.vector) for r in S.hash_vectors(d, "id", "t", 64).collect()}
    assert (v[1] == v[2]).all() and np.linalg.norm(v[1]) == pytest.approx(1, abs=1e-4) and not v[3].any() and v[1] @ v[4] > 0.3
