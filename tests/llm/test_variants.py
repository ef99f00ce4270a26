import unicodedata
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import variants as V


def plain(text):
    """The content rule, character by character."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    parts, now = [], ""
    for i, c in enumerate(t):
        if c in ",;|":
            parts.append(now)
            now = ""
        elif unicodedata.category(c)[0] in "LNM" or (c == "." and 0 < i < len(t) - 1 and t[i - 1].isdecimal() and t[i + 1].isdecimal()):
            now += c
    return tuple(sorted(p for p in [*parts, now] if p)) or None


def test_content():
    assert V.content("Type ３, ｖｉｒａｌ​") == V.content("viral; TYPE 3")
    assert V.content("6.5 mg") != V.content("65 mg") and V.content("6. 5") == V.content("65")
    assert V.content("é") == V.content("é") != V.content("e")
    assert V.content(" -,;") is None is V.content(None)
    assert V.content("x" * 300_000) == "x" * 300_000


def groups(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, a string, t string, k string, record string")
    records, members = V.collapse(df, "row_id", V.canonical_key([F.col("a")], F.col("t")))
    return {(r.row_id, r.n_copies) for r in records.collect()}, {(r.record, r.row_id) for r in members.collect()}


def test_collapse_with_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "x", "A b", "k", "r"), (2, "x", "a-B", "k", "r"), (3, None, "ab", "k", "r"), (4, None, "ab", "k", "r"), (5, "x", None, "", ""), (6, "x", " . ", "", ""), (7, "y", "ab", "", ""), (8, "x", "AB", "", "")]
    records, members = groups(spark, rows)
    assert members == {(1, 2), (1, 8)}
    assert records == {(1, 3), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)}
    assert groups(spark, []) == (set(), set())


def test_hot_group(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT", 10)
    df = spark.range(40_000).select(F.col("id").alias("row_id"), F.lit("x").alias("a"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("t"))
    records, members = V.collapse(df, "row_id", V.canonical_key([F.col("a")], F.col("t")))
    assert members.count() == 13_333 and members.select("record").distinct().count() == 1
    assert records.agg(F.sum("n_copies")).first()[0] == 40_000


def test_filter_misses_nothing_when_crowded(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_SEGMENTS", 1)
    monkeypatch.setattr(V, "SEGMENT_BITS", 1 << 10)
    df = spark.range(6000).select(F.md5((F.col("id") % 5000).cast("string")).alias("k"))
    segments, bits = V.repeated_filter(df, "k", 6000)
    hit = df.withColumn("m", V.may_repeat(df, "k", segments, bits)).groupBy("k").agg(F.count("*").alias("n"), F.min("m").alias("m"))
    assert hit.where("n > 1 and not m").count() == 0


def test_real_rows_against_brute_force(spark, small):
    exact = ["cui", "sab", "tty", "ispref", "suppress"]
    df = spark.read.parquet(f"{small}/labels.parquet")
    want = defaultdict(list)
    for r in df.collect():
        if (c := plain(r.label)) and all(r[e] is not None for e in exact):
            want[(*(r[e] for e in exact), c)].append(r.row_id)
    _, members = V.collapse(df, "row_id", V.canonical_key([F.col(c) for c in exact], F.col("label")))
    assert {(r.record, r.row_id) for r in members.collect()} == {(min(g), x) for g in want.values() for x in g if x != min(g)}


def test_positions_stay_in_one_segment():
    keys = np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64)
    a, b = V._positions(keys, 7) // np.uint64(V.SEGMENT_BITS)
    assert (a == b).all() and a.max() == 6


def test_shares_keep_the_filter_thin(spark, monkeypatch):
    """With room for a tenth of the keys the copies are the same, and hardly any lone row passes the filters."""
    df = spark.range(400_000).select(F.col("id"), F.md5(F.when(F.col("id") % 20 == 0, F.col("id") % 1000).otherwise(F.col("id")).cast("string")).alias("k"))
    df = df.withColumn("k", F.when(F.col("id") % 777 == 1, None).otherwise(F.col("k")))
    whole = {r.row_id: r.n_copies for r in V.collapse(df, "id", F.col("k"))[0].where("n_copies > 1").collect()}
    passed = []
    seen = V.may_repeat
    monkeypatch.setattr(V, "may_repeat", lambda part, c, n, bits: passed.append((part, n, bits)) or seen(part, c, n, bits))
    monkeypatch.setattr(V, "MAX_SEGMENTS", 1)
    monkeypatch.setattr(V, "SEGMENT_BITS", 1 << 19)
    records, members = V.collapse(df, "id", F.col("k"))
    assert {r.row_id: r.n_copies for r in records.where("n_copies > 1").collect()} == whole and len(passed) >= 9
    assert records.agg(F.sum("n_copies")).first()[0] == 400_000 and members.count() == 400_000 - records.count()
    lone = sum(part.where("id % 20 <> 0" if "id" in part.columns else "row_id % 20 <> 0").where(seen(part, "k", n, bits)).count() for part, n, bits in passed)
    assert lone < 0.1 * 380_000
