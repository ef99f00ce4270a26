"""Round trips: tables of the dataset written in each format the readers know and read back, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.plans.text import key_sql
from termloom.session import ensure_checkpoint_dir, table
from termloom.sources import readers as R
from termloom.sources import sinks as W


def _scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/formats-{uuid.uuid4()}"


def _xml(c: Column | str) -> Column:
    s = F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


def _lines(df: DataFrame, value: Column, path: str) -> str:
    df.select(value.alias("value")).write.mode("overwrite").text(path)
    return path


def _xml_lines(df: DataFrame, value: Column, path: str) -> str:
    """Elements within one root a file."""

    def rooted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["<root>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</root>"]})

    df.select(value.alias("value")).mapInPandas(rooted, "value string").write.mode("overwrite").text(path)
    return path


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "title", "text", "journal_id", "published_at").where("text is not null")


def _note(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the signs that have a meaning of their own in tagged and tabbed formats."""
    clean = lambda c: T.clean_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"[<>&|\"\\\x00-\x1f\u0085   ]", " "))
    return _docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), clean("title").alias("title"), clean("text").alias("text"), F.year("published_at").alias("year"))


def format_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark)
    W.jsonl(table(spark, sf, "evidence", "evidence_id", "cui", "text", "source", "evidence_type", "weight"), path)
    return R.evidence(spark, path).select("evidence_id", "cui", "text", "source", "evidence_type", "weight")


def format_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark) + ".csv"
    _note(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return R.tabular_corpus(spark, path, "notes", ["TEXT"], ["Id"], ["title"])


def format_query_log(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark) + ".tsv"
    e = table(spark, sf, "evidence", "cui", "norm_text", "weight").select(T.normalized_key(F.col("norm_text")).alias("Search"), "cui", F.col("weight").alias("frequency")).where("cui is not null and Search <> ''")
    e.write.option("header", True).option("sep", "\t").csv(path)
    return R.query_log(spark, path).select("text", "cui", "source", "evidence_type", "weight")


def format_types(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts of the wanted types, out of a pipe-delimited type file in which rows repeat."""
    lab = table(spark, sf, "labels", "row_id", "cui", "tty", "sab")
    path = _lines(lab, F.concat_ws("|", F.coalesce("cui", F.lit("")), F.coalesce(F.concat(F.lit("T"), "tty"), F.lit("")), F.coalesce("sab", F.lit("")), F.coalesce("sab", F.lit("")), F.col("row_id").cast("string"), F.lit("")), _scratch(spark))
    return R.concepts_of_types(R.semantic_types(spark, path), ["TPT", "msh"])


def format_obo(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "obo_terms", "term_id", "name", "definition", "parents").where("term_id is not null and trim(term_id) <> '' and name is not null")
    clean = lambda c: T.clean_text(F.regexp_replace(c, r'["\\\n\[]', " "))
    kept = F.filter(F.transform(F.coalesce("parents", F.array()), lambda p: F.regexp_extract(p, r"^\s*(\S+)", 1)), lambda p: p != "")
    stanza = F.concat(F.lit("[Term]\nid: "), F.trim("term_id"), F.lit("\nname: "), clean("name"), F.when(F.col("definition").isNotNull(), F.concat(F.lit('\ndef: "'), clean("definition"), F.lit('" []'))).otherwise(""), F.array_join(F.transform(kept, lambda p: F.concat(F.lit("\nis_a: "), p)), ""), F.lit("\n"))
    path = _lines(o, stanza, _scratch(spark))
    return R.obo_terms(spark, path).select("term_id", "name", "definition", F.array_join("parents", " ").alias("parents"))


def format_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation blocks of notes, each with its first word as the mention."""
    n = _note(spark, sf).where("title <> '' and text <> ''").withColumn("m", F.regexp_extract("text", r"^(\S+)", 1))
    value = F.concat("id", F.lit("|t|"), "title", F.lit("\n"), "id", F.lit("|a|"), "text", F.lit("\n"), F.concat_ws("\t", "id", F.lit("0"), F.length("m").cast("string"), "m", F.lit("T047"), F.lit("UMLS:C0000001")), F.lit("\n"))
    docs, mentions = R.pubtator(spark, _lines(n, value, _scratch(spark)))
    return docs.join(mentions, "pmid").select("pmid", "title", "abstract", "start", "end", "mention", "cui")


def format_articles(spark: SparkSession, sf: str) -> DataFrame:
    n = _note(spark, sf)
    value = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID Version=\"1\">"), "id", F.lit("</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("</Year></PubDate></JournalIssue></Journal><ArticleTitle>"), _xml("title"), F.lit("</ArticleTitle><Abstract><AbstractText Label=\"ALL\">"), _xml("text"), F.lit("</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"))
    return R.articles(spark, _xml_lines(n, value, _scratch(spark))).select("pmid", "title", "abstract", "journal", "year")


def format_full_texts(spark: SparkSession, sf: str) -> DataFrame:
    n = _note(spark, sf)
    value = F.concat(F.lit("<article><front><article-meta><article-id>"), "id", F.lit("</article-id><article-title>"), _xml("title"), F.lit("</article-title><license><p>CC BY</p></license><abstract><p>"), _xml("title"), F.lit("</p></abstract></article-meta></front><body><sec><title>Body</title><p>"), _xml("text"), F.lit("</p></sec></body></article>"))
    return R.full_texts(spark, _xml_lines(n, value, _scratch(spark)))


def format_health_topics(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "obo_terms", "row_id", "name", "namespace", "definition").where("name is not null")
    value = F.concat(F.lit('<health-topic id="'), F.col("row_id").cast("string"), F.lit('" title="'), F.replace(_xml("name"), F.lit('"'), F.lit("&quot;")), F.lit('" language="'), F.when(F.col("row_id") % 5 == 0, "Spanish").otherwise("English"), F.lit('"><also-called>'), _xml("name"), F.lit("</also-called><full-summary>&lt;p&gt;"), _xml("definition"), F.lit("&lt;/p&gt;</full-summary><group>"), _xml("namespace"), F.lit("</group></health-topic>"))
    t = R.health_topics(spark, _xml_lines(n, value, _scratch(spark)))
    return t.select("doc_id", "title", F.array_join("groups", ",").alias("groups"))


def format_genetics(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "obo_terms", "row_id", "namespace", "definition").where("namespace is not null")
    value = F.concat(F.lit("<summary><name>"), _xml("namespace"), F.lit("</name><key>k"), F.col("row_id").cast("string"), F.lit("</key><text-list><text><html>"), _xml(T.normalized_key(F.coalesce("definition", F.lit("")))), F.lit("</html></text></text-list><related-list><related><name>"), _xml("namespace"), F.lit("</name></related></related-list></summary>"))
    g = R.genetics_summaries(spark, _xml_lines(n, value, _scratch(spark)))
    return g.select("doc_id", "title", "text", F.array_join("related", ",").alias("related"))


def format_drug_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = _note(spark, sf)
    value = F.concat(F.lit("<document><setId>"), "id", F.lit("</setId><title>"), _xml("title"), F.lit("</title><component><structuredBody><section><title>Indications and usage</title><text>"), _xml("text"), F.lit("</text></section><section><title>Package label</title><text>none</text></section></structuredBody></component></document>"))
    return R.drug_labels(spark, _xml_lines(n, value, _scratch(spark)))


def format_trials(spark: SparkSession, sf: str) -> DataFrame:
    n = _note(spark, sf)
    study = F.struct(
        F.struct(F.struct(F.col("id").alias("nctId"), F.col("title").alias("briefTitle")).alias("identificationModule"), F.struct(F.col("text").alias("briefSummary")).alias("descriptionModule"), F.struct(F.array(F.col("title")).alias("conditions")).alias("conditionsModule"), F.struct(F.array(F.struct(F.col("title").alias("measure"), F.lit("change").alias("description"))).alias("primaryOutcomes")).alias("outcomesModule")).alias("protocolSection"),
        (F.col("year") % 2 == 0).alias("hasResults"),
    )
    path = _scratch(spark)
    n.select(study.alias("s")).select("s.*").write.json(path)
    whole = spark.read.text(path)
    return R.trials(spark, _each(whole, path + "-each"), outcomes_only=True, require_results=True)


def _each(lines: DataFrame, path: str) -> str:
    """The lines of JSON as one array a partition, as multi-line readers want them."""
    lines.groupBy(F.spark_partition_id().alias("p")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).select("value").write.text(path)
    return path


def format_page_specs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "relationship_edges", "source_cui", "target_cui", "relation", "label").where("relation is not null")
    path = _scratch(spark)
    W.jsonl(e.select(F.col("source_cui").alias("cui"), F.lit("Page").alias("title"), T.normalized_key(F.col("label")).alias("extract"), F.array(F.struct(F.col("relation").alias("name"), F.col("target_cui").alias("target"))).alias("relations")), path)
    return R.page_specs(spark, path).select("doc_id", "cui", "text", F.array_join("relations", ";").alias("relations"))


def format_relation_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "relationship_edges", "row_id", "source_cui", "target_cui", "relationship_type").where("source_cui is not null and target_cui is not null and relationship_type is not null")
    value = F.concat_ws("\t", F.col("row_id").cast("string"), F.upper("relationship_type"), F.concat(F.lit("Disease|"), "source_cui"), F.concat(F.lit("Chemical|"), "target_cui"))
    return R.relation_lines(spark, _lines(e, value, _scratch(spark)))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings", "vec_id", "embedding").select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("cui"), F.col("embedding").alias("vector"))


def _summed(v: DataFrame) -> DataFrame:
    return v.select("cui", F.size("vector").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("float").cast("double")), 4).alias("total"))


def format_word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return _summed(R.word_vectors(spark, _lines(v, F.concat_ws(" ", "cui", F.array_join(F.col("vector").cast("array<string>"), " ")), _scratch(spark))))


def format_object_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    value = F.concat(F.lit('{"'), "cui", F.lit('": ['), F.array_join(F.col("vector").cast("array<string>"), ", "), F.lit("]}"))
    return _summed(R.object_vectors(spark, _lines(v, value, _scratch(spark))))


def format_compact_vectors(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark)
    v = _vectors(spark, sf)
    W.compact_vectors(v, path, len(v.first().vector) if v.take(1) else 1)
    return _summed(R.compact_vectors(spark, path))


def format_judgments(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "external_cui_neighbors", "source_cui", "target_cui", "rank").where("rank is not null")
    return R.qrels(spark, _lines(n, F.concat_ws(" ", "source_cui", F.lit("0"), "target_cui", F.col("rank").cast("string")), _scratch(spark)))


def format_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics in three notations, which say the same."""
    q = table(spark, sf, "query_rows", "row_id", "search_term").select(F.col("row_id").cast("string").alias("id"), T.normalized_key(F.col("search_term")).alias("t")).where("t <> ''")
    xml = R.topics(spark, _xml_lines(q, F.concat(F.lit('<topic number="'), "id", F.lit('"><query>'), "t", F.lit("</query></topic>")), _scratch(spark)))
    delimited = R.delimited_topics(spark, _lines(q, F.concat("id", F.lit(":"), "t"), _scratch(spark)))
    tagged = R.tagged_topics(spark, _lines(q, F.concat(F.lit("<top>\n<num> Number: "), "id", F.lit("\n<title> "), "t", F.lit("\n</top>")), _scratch(spark)))
    return xml.unionByName(delimited).unionByName(tagged).groupBy("topic", "text").agg(F.count("*").alias("n"))


def format_bulk_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Action lines and documents of a bulk load, counted back."""
    path = _scratch(spark)
    W.bulk_lines(table(spark, sf, "labels", "row_id", "cui", "label"), path, "labels", "row_id", 1000)
    v = spark.read.text(path).select(F.when(F.col("value").startswith('{"index":'), F.get_json_object("value", "$.index._index")).otherwise("document").alias("kind"), F.coalesce(F.get_json_object("value", "$.index._id"), F.get_json_object("value", "$.row_id")).cast("long").alias("id"))
    return v.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def format_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edge lines flattened, strength and confidence from the nested edge, repeated ones once."""
    e = table(spark, sf, "relationship_edges", "source_class", "source_cui", "target_cui", "relationship_type", "edge_json").where("edge_json is not null")
    path = _scratch(spark)
    W.jsonl(e.select("source_class", F.col("source_cui").alias("subject_cui"), F.col("target_cui").alias("object_cui"), "relationship_type", F.col("edge_json").alias("edge")), path)
    return R.relation_edges(spark, path).select("source_class", "subject_cui", "object_cui", "relationship_type", "edge", F.round("strength", 6).alias("strength"), F.round("confidence", 6).alias("confidence"))


def format_pages(spark: SparkSession, sf: str) -> DataFrame:
    n = _note(spark, sf)
    html = F.concat(F.lit("<html><head><title>site</title><script>var x = 1;</script></head><body><h1>"), _xml("title"), F.lit("</h1><p>"), _xml("text"), F.lit("</p><!-- gone --></body></html>"))
    return R.pages(n.withColumn("html", html), "html", ["id"])


def table_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and distinct keys of the dictionary, the evidence and the edges, as an index would report them."""
    parts = []
    for name, key in (("labels", "cui"), ("evidence", "cui"), ("relationship_edges", "source_cui"), ("related_concepts", "source_cui")):
        parts.append(table(spark, sf, name, key).agg(F.count("*").alias("n"), F.count(key).alias("keyed"), F.countDistinct(key).alias("keys")).select(F.lit(name).alias("name"), "n", "keyed", "keys"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    f.__name__: f
    for f in (format_jsonl, format_corpus, format_query_log, format_types, format_obo, format_annotations, format_articles, format_full_texts, format_health_topics, format_genetics, format_drug_labels, format_trials, format_page_specs, format_relation_lines, format_word_vectors, format_object_vectors, format_compact_vectors, format_judgments, format_topics, format_bulk_lines, format_edges, format_pages, table_statistics)
}


def clean_sql(c: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({c}, '[ \t\r\n\f]+', ' ', 'g'), ' '), ' ([,.;:!?])', '\1', 'g')"


def _note_sql(c: str) -> str:
    return clean_sql(rf"regexp_replace(coalesce({c}, ''), '[<>&|" + r'"\\' + r"\x{00}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}]', ' ', 'g')")


_N = f"n as (select cast(doc_id as varchar) as id, {_note_sql('title')} as title, {_note_sql('text')} as text, cast(year(published_at) as integer) as year from documents where text is not null)"
_VEC = "select 'V' || vec_id as cui, cast(len(embedding) as integer) as dims, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total from embeddings"
_obo = lambda c: clean_sql(f"regexp_replace({c}, '[\"\\\\\\n\\[]', ' ', 'g')")

SQL = {
    "format_jsonl": "select evidence_id, cui, text, coalesce(source, '') as source, coalesce(evidence_type, '') as evidence_type, coalesce(weight, 1.0) as weight from evidence",
    "format_corpus": f"with {_N} select 'DOC_' || left(sha1('notes' || chr(9) || id), 20) as doc_id, 'notes' as source, text, title from n where text <> ''",
    "format_query_log": f"select {key_sql('norm_text')} as text, cui, 'query_log' as source, 'query' as evidence_type, coalesce(weight, 1.0) as weight from evidence where cui is not null and {key_sql('norm_text')} <> ''",
    "format_types": "with t as (select cui, 'T' || tty as tui, min(coalesce(sab, '')) as sty from labels where cui <> '' and tty is not null group by all) select distinct cui from t where lower(tui) in ('tpt', 'msh') or lower(sty) in ('tpt', 'msh')",
    "format_obo": f"""select trim(term_id, ' ') as term_id, {_obo('name')} as name, {_obo('definition')} as definition, array_to_string(list_filter(list_transform(coalesce(parents, []), lambda p: regexp_extract(p, '^\\s*(\\S+)', 1)), lambda p: p <> ''), ' ') as parents
from obo_terms where term_id is not null and trim(term_id, ' ') <> '' and name is not null""",
    "format_annotations": f"with {_N}, m as (select *, regexp_extract(text, '^(\\S+)', 1) as m from n where title <> '' and text <> '') select id as pmid, title, text as abstract, 0 as start, cast(length(m) as integer) as \"end\", m as mention, 'C0000001' as cui from m",
    "format_articles": f"with {_N} select id as pmid, title, case when text = '' then 'ALL:' else 'ALL: ' || text end as abstract, 'J' as journal, year from n",
    "format_full_texts": f"with {_N} select id as doc_id, title, trim(title || ' Body ' || text, ' ') as text, 'CC BY' as license from n",
    "format_health_topics": "select cast(row_id as varchar) as doc_id, name as title, coalesce(namespace, '') as groups from obo_terms where name is not null and row_id % 5 <> 0",
    "format_genetics": f"select 'k' || row_id as doc_id, namespace as title, coalesce({key_sql('definition')}, '') as text, namespace as related from obo_terms where namespace is not null",
    "format_drug_labels": f"with {_N} select id as doc_id, title, trim('Indications and usage ' || text, ' ') as text from n",
    "format_trials": f"with {_N} select id as doc_id, title, case when title = '' then '. change' else title || '. change' end as text from n where year % 2 = 0",
    "format_page_specs": f"select source_cui || ':page' as doc_id, source_cui as cui, 'Page. ' || {key_sql('label')} as text, case when target_cui is null then relation else relation || ' ' || target_cui end as relations from relationship_edges where relation is not null and source_cui is not null and {key_sql('label')} <> ''",
    "format_relation_lines": "select cast(row_id as varchar) as pmid, lower(relationship_type) as kind, 'disease' as subject_type, source_cui as subject, 'chemical' as object_type, target_cui as object from relationship_edges where source_cui is not null and target_cui is not null and relationship_type is not null",
    "format_word_vectors": _VEC,
    "format_object_vectors": _VEC,
    "format_compact_vectors": _VEC,
    "format_judgments": "select source_cui as topic, target_cui as doc, rank as grade from external_cui_neighbors where rank is not null",
    "format_topics": f"select cast(row_id as varchar) as topic, {key_sql('search_term')} as text, cast(3 as bigint) as n from query_rows where {key_sql('search_term')} <> ''",
    "format_bulk_lines": "select unnest(['labels', 'document']) as kind, count(*) as n, cast(sum(row_id) as bigint) as ids from labels",
    "format_edges": "select distinct source_class, source_cui as subject_cui, target_cui as object_cui, relationship_type, edge_json as edge, round(cast(edge_json ->> '$.strength' as double), 6) as strength, round(cast(edge_json ->> '$.confidence' as double), 6) as confidence from relationship_edges where edge_json is not null",
    "format_pages": f"with {_N} select id, case when title = '' then 'site' else title end as title, {clean_sql('trim(' + chr(39) + 'site ' + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || text)')} as text from n",
    "table_statistics": " union all ".join(f"select '{t}' as name, count(*) as n, count({k}) as keyed, count(distinct {k}) as keys from {t}" for t, k in (("labels", "cui"), ("evidence", "cui"), ("relationship_edges", "source_cui"), ("related_concepts", "source_cui"))),
}
