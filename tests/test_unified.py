import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from termloom.functions import lexical as X
from termloom.operators import judging as J
from termloom.operators import link as L
from termloom.operators import mentions as M
from termloom.operators import related as RL
from termloom.operators import unified as U
from termloom.sources import readers as R
from termloom.sources import sinks as W


def test_lanes_unite_with_nulls_ties_and_nothing(spark):
    q = spark.createDataFrame([(1, "heart attack in C0000001"), (2, None), (3, ""), (4, "acute pain of knee")], "query long, text string")
    names = spark.createDataFrame([("heart attack", "C9", 2)], "key string, cui string, n_tokens int")
    concepts = spark.createDataFrame([("C0000001",), (None,)], "cui string")
    lanes = {"label": U.label_lane(q, names, 8), "code": U.code_lane(q, concepts), "definition": U.definition_lane(q, spark.createDataFrame([("D1", "a painful acute state of the knees"), ("D2", None)], "cui string, text string"))}
    hits = {(r.query, r.cui): r for r in U.unite(lanes).collect()}
    assert set(hits) == {(1, "C9"), (1, "C0000001"), (4, "D1")} and hits[1, "C9"].in_label == 0.75 and hits[1, "C0000001"].lanes == "code"
    page = U.hydrate(U.page(U.unite(lanes), 10), spark.createDataFrame([("C9", "b"), ("C9", "a"), ("D1", None)], "cui string, label string"), spark.createDataFrame([("C9",)], "cui string"))
    got = {(r.query, r.place): (r.cui, r.label, r.evidence_count) for r in page.collect()}
    assert got[1, 1] == ("C0000001", None, 0) and got[1, 2] == ("C9", "a", 1) and (4, 1) in got
    assert U.answer(page).where("query = 1").first().n == 2
    assert U.unite({n: d.limit(0) for n, d in lanes.items()}).count() == 0
    assert U.pool_size(10, "precise") == 40 and U.pool_size(50, "balanced") == 200


def test_buckets_and_first_source(spark):
    edges = spark.createDataFrame([(1, "A", "B", "treats", "g", 0.9, 0.9), (2, "A", "C", "treats", None, 0.9, 0.9), (3, "A", "A", "treats", "g", 0.9, 0.9), (4, "A", "D", "x", "y", float("nan"), 0.9), (5, "A", "E", None, None, 0.7, None)], "row_id long, source_cui string, target_cui string, relationship_type string, relation_group string, strength double, confidence double")
    assert [(r.bucket, r.place, r.target_cui) for r in RL.buckets(edges, 0.58, 0.5, 6).orderBy("place").collect()] == [("treatments", 1, "B"), ("treatments", 2, "C")]
    one = edges.select("source_cui", "target_cui", "row_id")
    assert [(r.target_cui, r.origin) for r in RL.first_wins([one.where("row_id = 2"), one], 2).orderBy("place").collect()] == [("C", 1), ("B", 2)]
    assert RL.buckets(edges.limit(0), 0.5, 0.5, 3).count() == 0


def test_judged_lists(spark):
    hits = spark.createDataFrame([("q", "a", 3), ("q", "a", 1), ("q", "alt", 7), ("q", "bad", 2)], "query string, cui string, rank int")
    want = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "z")], "query string, cui string")
    bad, other = spark.createDataFrame([("q", "bad")], "query string, cui string"), spark.createDataFrame([("b", "alt")], "cui string, other string")
    got = {r.query: r for r in J.coverage(hits, want, bad, other).collect()}
    assert (got["q"].coverage_5, got["q"].coverage_10, got["q"].disallowed_10, got["q"].verdict) == (0.5, 1.0, 1, "mixed") and got["r"].verdict == "poor"
    r = J.retrieval(spark.createDataFrame([("t", "x", 1), ("t", "y", 2)], "topic string, doc string, rank int"), spark.createDataFrame([("t", "y", 1), ("t", "w", 2)], "topic string, doc string, grade int"), (1, 2)).first()
    assert (r.judged, r.precision_1, r.judged_2, r.reciprocal_rank, r.recall) == (1, 0.0, 0.5, 0.5, 0.5)
    graded = spark.createDataFrame([("q", "a", 1, 1), ("q", "a", -1, 2)], "query string, cui string, grade int, order int")
    assert {r.cui: r.grade for r in J.joined(hits, graded).collect()} == {"a": -1, "alt": None, "bad": None}


def test_abbreviations_of_inner_letters():
    assert M.abbreviations("Use polymerase chain reaction (PCR), heat shock factor (HSF) and (none)") == {"PCR": "polymerase chain reaction", "HSF": "heat shock factor"}
    assert M.abbreviations("We measured body mass index (BMI) twice; (BMI) again.") == {"BMI": "body mass index"} and M.abbreviations("(AB") == {}


def test_guard_refuses_columns_of_persons(spark):
    with pytest.raises(ValueError):
        X.guarded(spark.createDataFrame([(1, 2, "x")], "patient_id int, n int, t string"), "n", "t", 5)


def test_archives_tags_and_broken_lines(spark, tmp_path):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as archive:
        for name, xml in (("b/ch1.nxml", "<book><title>One</title><license>CC</license><p>Text &amp; more</p></book>"), ("b/toc.nxml", "<p>gone</p>")):
            raw = xml.encode()
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            archive.addfile(info, io.BytesIO(raw))
    (tmp_path / "b.tar.gz").write_bytes(data.getvalue())
    assert [tuple(r) for r in R.book_archives(spark, str(tmp_path / "b.tar.gz")).collect()] == [("ch1", "One", "Text & more", "CC")]
    (tmp_path / "t.txt").write_text("<top>\n<num> Number: 7\n<title> knee\n<desc> Description: pain of the knee\n</top>\n")
    assert [tuple(r) for r in R.tagged_topics(spark, str(tmp_path / "t.txt")).collect()] == [("7", "knee pain of the knee")]
    (tmp_path / "r.tsv").write_text("1\tTREAT\tDisease|D1\tChemical|C1\nbroken line\n")
    with pytest.raises(Exception, match="no relation"):
        R.relation_lines(spark, str(tmp_path / "r.tsv")).collect()
    (tmp_path / "v.json").write_text('{"a": [1, 2.5], "b":\n[ -1e3 ]}')
    assert {r.cui: r.vector for r in R.object_vectors(spark, str(tmp_path / "v.json")).collect()} == {"a": [1.0, 2.5], "b": [-1000.0]}


def test_compact_vectors_keep_rows_and_refuse_lengths(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("b", [3.0, 4.0])], "doc_id string, vector array<float>")
    assert W.compact_vectors(df, str(tmp_path / "v"), 2, block=2) == 3
    assert sorted((r.doc_id, r.vector) for r in R.compact_vectors(spark, str(tmp_path / "v")).collect()) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("b", [3.0, 4.0])]
    with pytest.raises(Exception, match="has not 3 numbers"):
        W.compact_vectors(df, str(tmp_path / "w"), 3)


@pytest.mark.parametrize("held", [200_000, 0])
def test_definition_lane_is_led_by_the_rarest_word(spark, monkeypatch, held):
    """Against brute force; and with two words that all texts hold and one that few do, few pairs come about."""
    monkeypatch.setattr(U, "HELD_WORDS", held)
    rnd = random.Random(3)
    words = ["renal", "renovascular", "ren", "knee", "kneecap", "acute", "acutely", "of", "pain", "painful", "1234", "ab"]
    text = lambda least, most: " ".join(rnd.choice(words) for _ in range(rnd.randint(least, most)))
    queries, defs = [(i, text(0, 5)) for i in range(150)], [(f"D{i % 40}", text(0, 7)) for i in range(120)] + [(None, "acute knee"), ("D1", None)]
    want = {}
    for i, q in queries:
        ts = {t for t in q.split() if len(t) >= 3}
        for cui, d in defs:
            w = set((d or "").split())
            if 2 <= len(ts) <= 8 and w and all(any(x.startswith(t) for x in w) for t in ts):
                want[i, cui] = max(want.get((i, cui), 0), len(ts) / len(w))
    q, d = spark.createDataFrame(queries, "query long, text string"), spark.createDataFrame(defs, "cui string, text string")
    got = U.definition_lane(q, d).collect()
    assert len(want) > 100 and {(r.query, r.cui): r.score for r in got} == want and len(got) == len(want)
    many = spark.range(1500).select((F.col("id")).alias("query"), F.concat(F.lit("condition described rare"), F.col("id") % 300).alias("text"))
    told = spark.range(1500).select(F.col("id").cast("string").alias("cui"), F.concat(F.lit("condition described as rare"), F.col("id") % 300, F.lit("x"), F.col("id")).alias("text"))
    found = U.definition_lane(many, told)
    found.collect()

    def most_rows(node):
        out, at, seen = 0, [node], 0
        while at:
            n = at.pop()
            seen += 1
            if "Join" in n.nodeName() and n.metrics().contains("numOutputRows"):
                out = max(out, n.metrics().apply("numOutputRows").value())
            inner = [n.executedPlan()] if "AdaptiveSparkPlan" in n.nodeName() else [n.plan()] if "QueryStage" in n.nodeName() else []
            children = n.children()
            at += inner + [children.apply(i) for i in range(children.size())]
        return out

    assert 0 < most_rows(found._jdf.queryExecution().executedPlan()) < 200_000


def test_texts_are_normalized_once(spark):
    """Filters on keys and words must not compute them again."""
    text = spark.range(10).select(F.col("id").alias("query"), F.concat(F.lit("Pain of knee "), F.col("id")).alias("text"), F.col("id").cast("string").alias("cui"))
    normalized = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("translate(")
    names = L.dictionary(text.withColumnRenamed("text", "label"), 8, 2)
    assert normalized(names) == 1 and {r.key for r in names.collect()} == {f"pain of knee {i}" for i in range(10)}
    assert normalized(U.definition_lane(text, text)) <= 2  # queries and definitions


def test_repeated_query_texts_are_searched_once(spark, small):
    """Against the SQL; the sample's search terms repeat."""
    duckdb = pytest.importorskip("duckdb")
    from termloom.plans import unified as P

    con = duckdb.connect()
    for name in ("query_rows", "search_quality_patient_portal_queries", "labels", "evidence", "obo_terms", "related_concepts", "external_cui_neighbors"):
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    q = P._queries(spark, small)
    texts = P._texts(q)
    assert texts.count() == q.select("text").distinct().count() < q.count() == texts.agg(F.sum("n")).first()[0]
    for name in ("search_united", "search_lanes"):
        got = __spark_entry__.queries()[name](spark, small)
        want = con.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert want and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_page_is_found_once(spark, small):
    """What fills in the page asks for its concepts several times, not for the search."""
    found = __spark_entry__.queries()["search_united"](spark, small)
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString() and found.where("place = 1").count() > 0
