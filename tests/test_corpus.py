import random
from hashlib import blake2b

import pytest
from pyspark.sql import functions as F

from termloom.operators import corpus as C
from termloom.operators import mentions as M


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_is_the_greedy_pass(spark, seed):
    rnd = random.Random(seed)
    docs = [(i, [f"k{rnd.randrange(60)}" for _ in range(rnd.randrange(0, 4))] + [f"id{i}"]) for i in range(120)]
    seen, want = set(), []
    for i, ks in docs:
        if not seen & set(ks):
            want.append(i)
            seen |= set(ks)
    df = spark.createDataFrame(docs, "n long, ks array<string>")
    assert sorted(r.n for r in C.merge_first_wins(df, F.col("ks"), "n").collect()) == want
    assert C.merge_first_wins(df.limit(0), F.col("ks"), "n").count() == 0


def test_corpus(spark):
    d = spark.createDataFrame([(1, "A title of more than twenty-four letters"), (2, "a TITLE of more than twenty four letters!"), (3, "short"), (4, None)], "doc_id long, title string")
    assert sorted(r.doc_id for r in C.merge_first_wins(d, C.identity_keys(d), "doc_id").collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in C.without_known(d, C.identity_keys(d), spark.createDataFrame([("id:3",)], "k string")).collect()) == [1, 2, 4]
    p = spark.createDataFrame([("a", ["x"], "L"), ("b", ["x", "y"], "L"), ("c", [], "L"), ("d", ["x"], None), ("e", None, "L")], "cui string, s array<string>, p string")
    assert [r.cui for r in C.public_view(p, F.col("s"), ["x"], F.col("cui"), F.col("p")).collect()] == ["a"]
    r = C.drop_reasons(p, {"no_label": F.col("p").isNull(), "many": F.size("s") > 1}).collect()
    assert {x.cui: x.drop_reason for x in r} == {"a": "", "b": "many", "c": "", "d": "no_label", "e": ""}
    h = spark.createDataFrame([("é",), (None,)], "t string").select(C.blake_hash(F.col("t")).alias("h")).collect()
    assert [x.h for x in h] == [blake2b("é".encode(), digest_size=16).hexdigest(), None]
    b = p.select("cui", C.first_bucket(F.col("s"), {"one": ["y"], "two": ["x"]}).alias("b")).collect()
    assert {x.cui: x.b for x in b} == {"a": "two", "b": "one", "c": "OTHER", "d": "two", "e": "OTHER"}
    lanes = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.5, 3.0)], "lane string, score double, weight double")
    caps = spark.createDataFrame([("c", "a", 0.9, 1, 0.1), ("d", "b", 0.9, 1, 0.3)], "cap string, lane string, below double, enough int, max_score double")
    s = C.scorecard(lanes, caps).first()
    assert (s.raw, s.score) == (pytest.approx(0.625), 0.3)


def test_mentions(spark):
    assert M.abbreviations("He has chronic kidney disease (CKD) and (ABC) and atrial fibrillation (AF).") == {"CKD": "chronic kidney disease", "AF": "atrial fibrillation"}
    text = "One two three. " * 40
    chunks = M.chunk(text)
    assert "".join(text[a:b] for a, b, _ in chunks) == text and all(70 <= n <= 95 for _, _, n in chunks[:-1])
    assert M.chunk("") == [] and M.chunk("word " * 300)[0][2] == 300
    for t, want in {
        "I was told gout was ruled out.": "negated", "No gout today": "negated", "My mother had gout": "family", "possible gout": "uncertain", "no pain but gout": "current",
        "history of gout": "historical", "gout was confirmed": "confirmed", "gout": "current", "No fever. gout": "current",
    }.items():
        at = t.index("gout")
        assert M.assertion(t, at, at + 4) == want, t
    d = spark.createDataFrame([(1, "No gout. GOUT!"), (2, None), (3, "")], "id long, t string")
    assert [(r.id, r.start_pos, r.status) for r in M.assert_mentions(d, ["id"], "t", ["gout"]).collect()] == [(1, 3, "negated"), (1, 9, "current")]
    assert M.plan_chunks(d.limit(0), ["id"], "t").count() == 0
    assert d.select(M.snippet(F.col("t"), F.lit("gout"), 2).alias("s")).first().s == "o gout. "
    many = spark.range(20).select(F.lit("k").alias("k"), "id")
    assert [r.id for r in M.spread(many, ["k"], ["id"], 7).orderBy("id").collect()] == [0, 3, 6, 10, 13, 16, 19]
