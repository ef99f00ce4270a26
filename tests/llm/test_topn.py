import random

from pyspark.sql import functions as F

from termloom.llm import topn as T


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 500)
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["hot"] * 5 + [f"g{rnd.randrange(300)}", None]), f"t{rnd.randrange(20)}", rnd.choice([None, float("nan"), float(rnd.randrange(6)), -0.0])) for i in range(6000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "row_id long, g string, t string, s double").withColumn("c", F.lit(1)).repartition(4)
    got = sorted((r.g, r.top_rank, r.row_id) for r in T.top_n(df, "g", -F.col("s"), ["t", "row_id"], 5).collect())
    by = {}
    for i, g, t, s in rows:
        if g is not None and s is not None and s == s:
            by.setdefault(g, []).append((-s + 0.0, t, i))
    assert got == sorted((g, k, x[2]) for g, v in by.items() for k, x in enumerate(sorted(v)[:5], 1))


def test_empty_and_few_bounds(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1, float(i)) for i in range(200)] + [("b", 1, float(i)) for i in range(100)], "g string, top_rank int, s double")
    assert T.top_n(df.limit(0), "g", F.col("s"), ["s"], 3).count() == 0
    monkeypatch.setattr(T, "MAX_BOUNDS", 1)
    assert sorted((r.g, r.s, r.top_rank) for r in T.top_n(df, "g", F.col("s"), ["s"], 2).collect()) == [("a", 0.0, 1), ("a", 1.0, 2), ("b", 0.0, 1), ("b", 1.0, 2)]


def test_scores_in_their_own_type(spark):
    rows = [("a", 2**53 + 1, "x"), ("a", 2**53, "y"), ("a", 2**53 + 2, "z")] + [("b", i, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "g string, s long, t string")
    assert [r.t for r in T.top_n(df, "g", F.col("s"), ["t"], 2).where("g = 'a'").orderBy("top_rank").collect()] == ["y", "x"]
    dated = df.withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("s").cast("int") % 40)).where("g = 'b'")
    assert [r.s for r in T.top_n(dated, "g", F.col("d"), ["s"], 3).orderBy("top_rank").collect()] == [0, 40, 1]
    exact = df.withColumn("m", F.col("s").cast("decimal(30,10)"))
    assert [r.t for r in T.top_n(exact, "g", -F.col("m"), ["t"], 1).where("g = 'a'").collect()] == ["z"]
