"""Core operators over small tables: nulls, ties, repeats, empty tables."""

import math

import pytest
from pyspark.sql import functions as F

from termloom.functions import ids
from termloom.functions import text as T
from termloom.operators import dictionary as D
from termloom.operators import evaluation as V
from termloom.operators import evidence as E
from termloom.operators import graph as G
from termloom.operators import incremental as I
from termloom.operators import link as L
from termloom.operators import rerank as R
from termloom.operators import search as S
from termloom.operators.cumulative import running_total
from termloom.streaming import events as EV


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    lit = F.lit
    assert one(spark, T.normalized_key(lit("Sjöbrannick’s  Ｔest-2"))) == "sjobrannicks test 2"
    assert one(spark, T.clean_text(lit(" a\n b ,c\x00"))) == "a b,c"
    assert one(spark, T.feature_tokens(lit("ab cd"))) == ["ab", "cd", "abc", "bcd", "abcd"]
    assert one(spark, T.feature_tokens(lit(""))) == []
    assert [r["text"] for r in one(spark, T.ngrams(F.array(lit("a"), lit("b"), lit("c")), 2))] == ["a", "a b", "b", "b c", "c"]
    stems = {"bodies": "body", "halves": "half", "running": "run", "stopped": "stop", "kidneys": "kidney", "virus": "virus", "diabetes": "diabetes", "gas": "gas"}
    for w, s in stems.items():
        assert one(spark, T.stem(lit(w))) == s
    assert one(spark, T.display_label(lit("cyst; renal"))) == "renal cyst" and one(spark, T.display_label(lit("a;b;c"))) == "a;b;c"
    assert one(spark, T.privacy_flags(lit("x@y.org 212-555-0100 é"))) == ["email_like", "phone_like", "non_ascii"]
    assert one(spark, T.normalized_key(F.lit(None).cast("string"))) is None
    q = F.array(*map(lit, ["the", "renal", "cyst"]))
    assert one(spark, T.label_relevance(q, F.array(lit("renal"), lit("cyst")))) == pytest.approx(0.93)
    assert one(spark, T.label_relevance(q, F.array(lit("renal"), lit("mass")))) == pytest.approx(0.25 + 0.175 + 0.03)
    assert one(spark, T.label_relevance(q, F.array(lit("x")))) == 0


def test_ids(spark):
    lit = F.lit
    for v, k in {"c0001234": "CUI", "A12345678": "AUI", "AT9": "ATUI", "T047": "TUI", "x": "", "": ""}.items():
        assert one(spark, ids.identifier_type(lit(v))) == k
    assert tuple(one(spark, ids.system_code(lit("snomed: 12")))) == ("SNOMEDCT_US", "12") and one(spark, ids.system_code(lit("12"))) is None
    assert one(spark, ids.release_order(lit("2024AB"))) > one(spark, ids.release_order(lit("2024AA"))) > one(spark, ids.release_order(lit("x"))) == 0


LABELS = [(1, "C1", "Renal cyst", "A", "PT", "Y", "N"), (2, "C1", "RENAL CYST", "A", "SY", "N", "N"), (3, "C1", "kidney cysts", "B", "SY", "N", "O"), (4, "C2", "cyst", "A", "PT", "Y", "N"), (5, "C2", None, "A", "PT", "Y", "N"), (6, "C3", "renal cyst", "B", "PT", "N", "E")]


def labels(spark):
    return spark.createDataFrame(LABELS, "row_id long, cui string, label string, sab string, tty string, ispref string, suppress string")


def test_dictionary(spark):
    d = labels(spark)
    find = lambda *a: sorted(r.row_id for r in D.search_labels(d, *a).collect())
    assert find("renal CYST", "exact") == [1, 2, 6] and find("cyst", "words") == [1, 2, 4, 6] and find("cyst kidneys", "normalizedWords") == [3]
    assert find("renal, cyst", "normalizedString") == [1, 2, 6] and find("cyst", "leftTruncation") == [1, 2, 4, 6] and find("kidney", "rightTruncation") == [3]
    assert find("kidney mass", "words", True) == [3] and find("mass", "words", True) == []
    assert d.where(D.visible(F.col("suppress"), obsolete=True)).count() == 5
    assert {(r.cui, r.row_id) for r in D.best_rows(d, ["cui"]).collect()} == {("C1", 1), ("C2", 4), ("C3", 6)}
    assert {(r.cui, r.place, r.label) for r in D.labels_per_concept(d, 1).collect()} == {("C1", 1, "Renal cyst"), ("C2", 1, "cyst"), ("C3", 1, "renal cyst")}


def test_evidence_documents(spark):
    rows = [(1, "C1", "v", "A b.", "s", "e1", 1.0), (2, "C1", "v", "a B", "t", "e2", 2.0), (3, "C1", "v", "other", None, "e3", None), (4, "C1", "v", None, "s", "e4", 9.0), (5, "C1", "v", "a B", "t", "e5", 2.0)]
    e = spark.createDataFrame(rows, "row_id long, cui string, view string, text string, source string, evidence_id string, weight double")
    assert [(r.place, r.text, r.weight) for r in E.top_texts(e, 5).orderBy("place").collect()] == [(1, "a B", 2.0), (2, "other", 1.0)]
    doc = E.concept_documents(e, spark.createDataFrame([("C1", ["x"])], "cui string, labels array<string>"), 5)
    assert doc.first().text == "CUI: C1\nEvidence view: v\nLabels:\n- x\nEvidence:\n- a B (weight 2.0)\n- other" and doc.first().evidence_count == 5
    assert [(r.place, r.text, r.weight) for r in E.parse_bullets(doc).orderBy("place").collect()] == [(1, "a B", 2.0), (2, "other", 1.0)]
    assert {(r.source, r["rank"]) for r in E.first_sources(e, 1).collect()} == {("s", 1), ("t", 1), ("", 1)}
    assert [r.row_id for r in E.keep(e, {"source": ["s", "t"]}, {"source": ["t"]}).orderBy("row_id").collect()] == [1, 4]
    assert E.concept_documents(e.limit(0), spark.createDataFrame([], "cui string, labels array<string>"), 5).count() == 0


def test_graph(spark):
    rows = [(1, "a", "b", "RO", "isa", "o"), (2, "a", "b", "PAR", None, "o"), (3, "a", "c", "SY", "", "o"), (4, "a", "a", "RO", "", "o"), (5, "b", "d", "RO", None, "o"), (6, "c", "d", "RO", None, "o")]
    e = spark.createDataFrame(rows, "row_id long, source_cui string, target_cui string, relation string, rela string, direction string")
    assert [(r.target_cui, r.row_id) for r in G.best_edges(e, 2).where("source_cui = 'a'").orderBy("place").collect()] == [("b", 1), ("c", 3)]
    assert {(r.name, r.way) for r in G.both_ways(e).where("row_id in (1, 2)").collect()} == {("isa", "outgoing"), ("inverse_isa", "incoming"), ("PAR", "outgoing"), ("inverse_PAR", "incoming")}
    assert [(r.a, r.c, r.ways, r.first_via) for r in G.two_hops(e, 5).collect()] == [("a", "d", 2, "b")]
    s = spark.createDataFrame([(1, "a", "b", "g", 0.5, 0.5), (2, "a", "c", "g", float("nan"), 1.0), (3, "a", "b", "g", None, None)], "row_id long, source_cui string, target_cui string, g string, strength double, confidence double")
    assert [(r.target_cui, r.strength) for r in G.grouped_view(s, "g", 2).orderBy("place").collect()] == [("b", 0.5), ("c", 0.0)]
    assert G.graph_score(s, 0.1, 1.0).first().score == pytest.approx(0.1)


def test_incremental(spark):
    a = spark.createDataFrame([("k", "x"), ("k", "y"), ("k", "x"), ("o", "z")], "k string, v string")
    b = spark.createDataFrame([("k", "y"), ("k", "x"), ("n", None)], "k string, v string")
    fa, fb = I.fingerprints(a, "k", ["v"]), I.fingerprints(b, "k", ["v"])
    assert {(r.k, r.change) for r in I.diff(fa, fb, "k").collect()} == {("o", "removed"), ("n", "added")}
    docs = spark.createDataFrame([("1", "h"), ("2", "new"), ("3", "h"), ("4", "h"), ("5", "h")], "doc_id string, text_hash string")
    old = spark.createDataFrame([("1", "h"), ("2", "h"), ("4", "h"), ("5", "h")], "doc_id string, text_hash string")
    vec = spark.createDataFrame([("1", "h", 1, [1.0]), ("1", "h", 2, [1.0, 2.0]), ("4", "h", 1, [1.0])], "doc_id string, text_hash string, order int, vector array<double>")
    assert {(r.doc_id, r.reason) for r in I.reuse_plan(docs, old, vec, 2).collect()} == {("1", "unchanged"), ("2", "text_changed"), ("3", "new_document"), ("4", "wrong_length"), ("5", "no_vector")}
    assert {(r.doc_id, r.problem) for r in I.assembly_problems(docs.limit(2), vec, 2).collect()} >= {("2", "missing"), ("1", "duplicate"), ("4", "extra"), ("4", "length")}


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, "x", 3), (2, "b", 4)], "query long, cui string, rank int")
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c"), (1, "a")], "query long, cui string")
    r = {x.query: x for x in V.row_metrics(hits, want).collect()}
    assert (r[1].recall, r[1].reciprocal_rank, r[2].found_at_3, r[2].found_at_5, r[3].reciprocal_rank) == (0.5, 1.0, 0, 1, 0.0)
    s = {(x.grain, x.value): x for x in V.summary(V.row_metrics(hits, want).withColumn("g", F.col("query") > 1), ["g"]).collect()}
    assert s["all", ""].n == 3 and s["g", "true"].mrr == pytest.approx(0.125)
    m = spark.createDataFrame([("a", 0.5), ("b", 0.2)], "metric string, value double")
    base = spark.createDataFrame([("a", 0.51), ("c", 0.1)], "metric string, value double")
    assert {(x.metric, x.passed) for x in V.gates(m, base, 0.02).collect()} == {("a", True), ("b", False), ("c", False)}
    st = spark.createDataFrame([("g", 1, 1.0, False), ("g", 2, 3.0, True), ("g", 3, 4.0, False)], "group string, stage int, value double, rejected boolean")
    assert [(x.since_first, x.since_kept) for x in V.progression(st).orderBy("stage").collect()] == [(0.0, 0.0), (2.0, 2.0), (3.0, 3.0)]


def test_search(spark, monkeypatch):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "b", [1.0, 1.0]), (4, "c", [1.0, 0.1])], "row_id long, cui string, v array<double>")
    q = v.select(F.col("row_id").alias("query"), "v")
    for block in (2048, 2):
        monkeypatch.setattr(S, "QUERY_BLOCK", block)
        got = {(r.query, r["rank"]): r.cui for r in S.knn(q, v, 2).collect()}
        assert got[1, 1] == "c" and got[1, 2] == "b" and got[4, 1] == "a" and len(got) == 8
    assert S.knn(q.limit(0), v, 2).count() == 0
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "x", "z"]), (3, [])], "doc long, terms array<string>")
    qs = spark.createDataFrame([(9, ["z", "x", "x"])], "query long, terms array<string>")
    r = {x.doc: x.score for x in S.bm25(docs, qs).collect()}
    assert set(r) == {1, 2} and r[2] > r[1] > 0
    assert r[1] == pytest.approx(math.log(1 + (3 - 2 + 0.5) / 2.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / (5 / 3))))


def test_link(spark):
    names = L.dictionary(spark.createDataFrame([("renal cyst", "C1"), ("cyst", "C2"), ("renal", "C3"), ("renal", "C4"), ("renal", "C5"), ("ab", "C6"), (None, "C7")], "label string, cui string"), 6, 2)
    assert {(r.key, r.cui) for r in names.collect()} == {("renal cyst", "C1"), ("cyst", "C2")}
    docs = spark.createDataFrame([(1, "Renal cyst, cyst and renal cyst"), (2, ""), (3, "none")], "doc long, text string")
    assert {(r.doc, r.cui, r.n_mentions, r.first_start) for r in L.link(docs, names, 6, 1).collect()} == {(1, "C1", 1, 1), (1, "C2", 1, 3)}


def test_rerank(spark):
    h = spark.createDataFrame([(1, "a", 0.9, 1.0, True, 3, True), (1, "b", 0.5, 0.0, False, 0, False)], "query long, cui string, vector_score double, relevance double, exact boolean, evidence_count int, qualified boolean")
    r = {x.cui: x.rank_score for x in R.score(h).collect()}
    assert r["a"] == pytest.approx(0.12 + 0.03 + 0.04 * 0.1 / 0.45 + 0.18 + 0.04) and r["b"] == pytest.approx(-0.35)
    assert [x.cui for x in R.cutoff(h, [F.col("vector_score") > 2, F.col("evidence_count") > 0]).collect()] == ["a"]
    t = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["x", "y"]), (1, "c", ["x"]), (2, "d", ["x"])], "query long, cui string, tokens array<string>")
    assert sorted((x.cui, x.rivals) for x in R.less_specific(t, 0.1).collect()) == [("a", 1), ("c", 1)]
    d = spark.createDataFrame([(1, "a", ["x"], 0.9), (1, "b", ["x"], 0.8), (1, "c", ["y"], 0.1)], "query long, cui string, covered array<string>, rank_score double")
    assert [x.cui for x in R.diverse(d, 2).orderBy("place").collect()] == ["a", "c"]
    p = spark.createDataFrame([(i, j == 0, float(j == 0), 0.5) for i in range(20) for j in range(3)], "query long, relevant boolean, good double, flat double")
    w = R.pairwise_weights(p, ["good", "flat"])
    assert w["good"] > 0.2 and w["flat"] == 0


def test_running_total_is_exact_under_skew(spark):
    df = spark.range(5000).select((F.col("id") % 3 > 0).cast("int").alias("g"), "id", F.lit("x").alias("total"))
    got = running_total(df, ["g", "id"], F.col("id"), "before").orderBy("g", "id").collect()
    run = 0
    for r in got:
        assert r.before == run
        run += r.id
    assert running_total(df.limit(0), ["g", "id"], F.col("id"), "before").count() == 0


def test_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, make in (("t", EV.tumbling), ("s", EV.sessions), ("f", EV.first_seen)):
        made = make(stream)
        q = made.writeStream.format("memory").queryName(name).outputMode("append" if name == "f" else "append").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
        # what the watermark has not closed yet is not out; all that is out equals the static result
        out = {tuple(r) for r in spark.table(name).collect()}
        whole = {tuple(r) for r in make(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
        assert out and out <= whole
    q = stream.writeStream.foreachBatch(EV.upsert_into(str(tmp_path / "out"), "user_id", "ts")).option("checkpointLocation", str(tmp_path / "cu")).trigger(availableNow=True).start()
    q.awaitTermination()
    version = spark.read.text(str(tmp_path / "out" / "current")).first()[0]
    kept = spark.read.parquet(str(tmp_path / "out" / version))
    assert kept.count() == events.select("user_id").distinct().count() == kept.select("user_id").distinct().count()


def test_entry_contract(spark):
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 80
    assert entry.entry(spark).count() > 0
