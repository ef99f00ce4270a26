import math

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import mixing as M


def test_permutation():
    for n in (1, 2, 3, 100, 1000):
        p = M._permute(np.arange(n), n, "k")
        assert sorted(p) == list(range(n))
    assert (M._permute(np.arange(100), 100, "a") != M._permute(np.arange(100), 100, "b")).any()


def test_shard_counts_add_up():
    total = np.array([1000, 37, 0, 5])
    seen = [M.shard_counts(total, i, 11, 100, 3) for i in range(11)]
    assert (sum(h for _, h in seen) == total).all() and {int(h.sum()) for _, h in seen[:-1]} == {100}
    run = np.zeros(4, int)
    for before, here in seen:
        assert (before == run).all()
        run += here


def test_mix(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 97 == 0, None).when(F.col("id") % 89 == 0, "other").otherwise("big").alias("source"), (F.col("id") % 50).alias("n"))
    docs = docs.withColumn("block", F.lit("clash"))
    targets = spark.createDataFrame([("small", 0.3, 2), ("big", 0.6, 1), ("absent", 0.1, 1)], "source string, target_share double, max_repeats int")
    draws, shares = M.mix(docs, "doc_id", "source", "n", targets, block=16, shard=64)
    s = {r.source: r for r in shares.collect()}
    assert abs(s["small"].actual_share - 1 / 3) < 0.01 and abs(s["big"].actual_share - 2 / 3) < 0.01
    assert s["absent"].drawn_tokens == s["other"].drawn_tokens == 0
    # no token of a document more often than allowed
    over = draws.join(targets, "source").groupBy("doc_id", "from_token", "max_repeats").count().where("count > max_repeats")
    assert over.count() == 0
    assert draws.where("to_token - from_token < 1").count() == 0
    again = M.mix(docs, "doc_id", "source", "n", targets, block=16, shard=64)[0]
    assert again.exceptAll(draws).count() == draws.exceptAll(again).count() == 0
    assert draws.groupBy("shard").agg(F.countDistinct("slot").alias("n")).where("n > 64").count() == 0


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, n long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    draws, shares = M.mix(docs, "doc_id", "source", "n", targets)
    assert draws.count() == 0 and shares.first().actual_share == 0


def test_large_draws_are_exact():
    """Counts beyond a billion slots: sums hold, and the spread is that of a draw without replacement."""
    total = np.array([6_000_000_000, 3_000_000_000, 7])
    drawn = np.array([M._draw(total, 4_000_000_000, np.random.default_rng(i)) for i in range(300)])
    assert (drawn.sum(axis=1) == 4_000_000_000).all() and (drawn <= total).all()
    n, k, good = int(total.sum()), 4_000_000_000, int(total[0])
    sd = (k * good / n * (1 - good / n) * (n - k) / (n - 1)) ** 0.5
    assert abs(drawn[:, 0].mean() - k * good / n) < 4 * sd / 300**0.5 and 0.85 < drawn[:, 0].std() / sd < 1.15
    small = np.array([M._hypergeometric(5, 7, 6, np.random.default_rng(i)) for i in range(4000)])
    wanted = [math.comb(5, x) * math.comb(7, 6 - x) / 924 for x in range(6)]
    assert np.abs(np.bincount(small, minlength=6) / 4000 - wanted).max() < 0.04


def test_long_texts_count_as_whole(monkeypatch):
    enc = M._encoder(M.VOCABULARY)
    text = "".join(f"Line {i},\n\n   indented  it's  Größe 例え {i * 7}!\t\n" for i in range(400))
    parts = list(M.stretches(text, 300))
    assert "".join(parts) == text and len(parts) > 20
    assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))
    assert list(M.stretches("x" * 1000, 10)) == ["x" * 1000]


def test_asked_total_and_short_source(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "small").otherwise("big").alias("source"), F.lit(50).alias("n"))
    targets = spark.createDataFrame([("small", 0.5, 2), ("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in M.mix(docs, "doc_id", "source", "n", targets, block=10, shard=64, total_tokens=20_000)[1].collect()}
    assert s["small"].drawn_tokens == 2000 and s["big"].drawn_tokens == 10_000 and abs(s["small"].actual_share - 1 / 6) < 1e-9
