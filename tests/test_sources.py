import gzip
import json

import pytest

from termloom.sources import readers as R
from termloom.sources import sinks as S


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_jsonl_and_defaults(spark, tmp_path):
    p = tmp_path / "e.jsonl.gz"
    p.write_bytes(gzip.compress(b'{"evidence_id":"1","cui":"C1","text":"x"}\n\n{"evidence_id":"2","cui":"C1","text":"y","weight":2.5,"source":"s"}\n'))
    assert [(r.source, r.weight) for r in R.evidence(spark, str(p)).orderBy("evidence_id").collect()] == [("", 1.0), ("s", 2.5)]
    with pytest.raises(Exception):
        R.corpus(spark, write(tmp_path / "bad.jsonl", '{"doc_id": \n')).collect()


def test_tabular_and_query_log(spark, tmp_path):
    p = write(tmp_path / "t.csv", 'ID,Body,Name\n1," a  b ",T\n2,,U\n')
    got = R.tabular_corpus(spark, p, "s", ["body"], ["id"], ["name"]).collect()
    assert [(r.text, r.title, r.doc_id[:4], len(r.doc_id)) for r in got] == [("a b", "T", "DOC_", 24)]
    q = R.query_log(spark, write(tmp_path / "q.tsv", "search\tcui\tfrequency\tweight\nfoo\tC1\t7\t\nbar\tC2\t3\t0.5\n")).orderBy("cui").collect()
    assert [(r.text, r.weight) for r in q] == [("foo", 7.0), ("bar", 0.5)]
    with pytest.raises(Exception):
        R.query_log(spark, write(tmp_path / "r.tsv", "query\tcui\nfoo\t\n")).collect()
    with pytest.raises(ValueError):
        R.query_log(spark, write(tmp_path / "s.tsv", "a\tb\n1\t2\n"))


def test_pipe_and_obo(spark, tmp_path):
    p = write(tmp_path / "a.rrf", "C1|ENG|P|L1|PF|S1|Y|A1||X||MSH|PT|D1|Label|0|N||\n")
    r = R.pipe_file(spark, p, "atoms").first()
    assert (r.cui, r.sab, r.tty, r.label, r.suppress, r.scui) == ("C1", "MSH", "PT", "Label", "N", "X")
    text = 'format-version: 1.2\n\n[Term]\nid: X:1\nname: root\ndef: "A \\"b\\" c." [ref]\n\n[Term]\nid: X:2\nname: leaf\nsynonym: "tip" EXACT []\nxref: Q:9\nis_a: X:1 ! root\nis_a: X:7\n\n[Term]\nid: X:3\nis_obsolete: true\n\n[Typedef]\nid: part_of\n'
    terms = {r.term_id: r for r in R.obo_terms(spark, write(tmp_path / "o.obo", text)).collect()}
    assert set(terms) == {"X:1", "X:2"} and terms["X:2"].parents == ["X:1", "X:7"] and terms["X:2"].synonyms == ["tip"] and terms["X:2"].xrefs == ["Q:9"]
    assert terms["X:1"].parents == [] and terms["X:1"].definition.startswith("A ")


def test_annotations_topics_judgments(spark, tmp_path):
    p = write(tmp_path / "p.txt", "1|t|Title\n1|a|Abstract text\n1\t0\t5\tTitle\tT1\tUMLS:C9\n\n2|t|Other\n2|a|\n")
    docs, mentions = R.pubtator(spark, p)
    assert [(r.pmid, r.abstract) for r in docs.orderBy("pmid").collect()] == [("1", "Abstract text"), ("2", "")]
    assert [(r.start, r.end, r.cui) for r in mentions.collect()] == [(0, 5, "C9")]
    x = write(tmp_path / "t.xml", '<topics><topic number="1"><disease>Gout</disease><gene>AB1</gene></topic></topics>')
    assert [(r.topic, r.text) for r in R.topics(spark, x).collect()] == [("1", "Gout AB1")]
    assert R.qrels(spark, write(tmp_path / "q.txt", "1 0 D7 2\n\n")).first().grade == 2


def test_articles_and_trials(spark, tmp_path):
    x = "<S><PubmedArticle><MedlineCitation><PMID Version='1'>5</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText Label='AIM'>a</AbstractText><AbstractText Label='END'>b</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></S>"
    r = R.articles(spark, write(tmp_path / "a.xml", x)).first()
    assert (r.pmid, r.title, r.abstract, r.journal, r.year) == ("5", "T", "AIM: a END: b", "J", 2020)
    j = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "B"}, "descriptionModule": {"briefSummary": "S."}, "conditionsModule": {"conditions": ["x", "y"]}}}
    assert R.trials(spark, write(tmp_path / "n.json", json.dumps(j))).first().text == "S. x; y"


def test_vectors_and_sinks(spark, tmp_path):
    assert R.word_vectors(spark, write(tmp_path / "w.txt", "2 2\nC1 1.0 2.0\nC2,3,4\n")).orderBy("cui").first().vector == [1.0, 2.0]
    v = R.object_vectors(spark, write(tmp_path / "o.json", '{"C1": [1, 2],\n "C2": [3, 4]}')).orderBy("cui")
    assert [(r.cui, r.vector) for r in v.collect()] == [("C1", [1.0, 2.0]), ("C2", [3.0, 4.0])]
    assert S.vectors(v, str(tmp_path / "v"), 2) == 2 == S.jsonl(v, str(tmp_path / "j"))
    with pytest.raises(Exception):
        S.vectors(v, str(tmp_path / "v2"), 3)
    assert S.bulk_lines(v, str(tmp_path / "b"), "idx", "cui", 1) == 2
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "b")).collect()]
    assert len(lines) == 4 and {x["index"]["_id"] for x in lines if "index" in x} == {"C1", "C2"}


def test_pages(spark):
    html = "<html><head><title>T &amp; U</title><script>x()</script></head><body><h1>Head</h1><!-- no --><p>One&nbsp;two .</p></body></html>"
    r = R.pages(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "html", ["id"]).orderBy("id").collect()
    assert r[0].title == "Head" and r[0].text == "T & U Head One two." and r[1].text is None


def test_article_section_without_text_keeps_its_label(spark, tmp_path):
    x = "<S>" + "".join(f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><Abstract>{a}</Abstract></Article></MedlineCitation></PubmedArticle>" for i, a in ((1, "<AbstractText Label='ALL'></AbstractText>"), (2, "<AbstractText Label='AIM'/><AbstractText Label='END'>b</AbstractText>"), (3, "<AbstractText>c</AbstractText>"))) + "</S>"
    assert {r.pmid: r.abstract for r in R.articles(spark, write(tmp_path / "a.xml", x)).collect()} == {"1": "ALL:", "2": "AIM: END: b", "3": "c"}
