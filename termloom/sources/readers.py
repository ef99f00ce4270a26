"""Sources: each returns a DataFrame with the columns its docstring names. Paths may be files, folders or patterns;
gzip is read as it is. Null and missing fields take the stated defaults."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import ids
from termloom.functions import text as T

CORPUS = "doc_id string, source string, text string, title string, metadata string"
EVIDENCE = "evidence_id string, cui string, text string, source string, evidence_type string, weight double, metadata string"
DOCUMENT = "doc_id string, cui string, view string, text string, evidence_count long, sources array<string>, labels array<string>, metadata string"
VECTOR = "doc_id string, cui string, view string, vector array<double>, text string, metadata string"
EDGE = "source_class string, subject_cui string, subject_label string, object_cui string, object_label string, relationship_type string, relation string, rela string, relation_group string, source string, edge string, context string, strength double, confidence double"

# Positions of the fields of the pipe-delimited release files.
PIPE_FIELDS = {
    "atoms": {"cui": 0, "lat": 1, "ts": 2, "stt": 4, "ispref": 6, "aui": 7, "scui": 9, "sdui": 10, "sab": 11, "tty": 12, "code": 13, "label": 14, "suppress": 16},
    "types": {"cui": 0, "tui": 1, "stn": 2, "sty": 3, "atui": 4},
    "relations": {"cui1": 0, "rel": 3, "cui2": 4, "rela": 7, "rui": 8, "sab": 10, "suppress": 14},
    "definitions": {"cui": 0, "aui": 1, "atui": 2, "sab": 4, "definition": 5, "suppress": 6},
    "attributes": {"cui": 0, "stype": 4, "atn": 8, "sab": 9, "atv": 10},
}


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped and a malformed line ends the job with its text."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, CORPUS)


def evidence(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, EVIDENCE).withColumns({"source": F.coalesce("source", F.lit("")), "evidence_type": F.coalesce("evidence_type", F.lit("")), "weight": F.coalesce("weight", F.lit(1.0))})


def concept_documents(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, DOCUMENT)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, VECTOR)


def relation_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge lines flattened; strength and confidence of the nested edge count where the line has none."""
    e = jsonl(spark, path, EDGE).withColumn("j", F.from_json("edge", "strength double, confidence double"))
    return e.withColumn("strength", F.coalesce("strength", "j.strength")).withColumn("confidence", F.coalesce("confidence", "j.confidence")).drop("j").dropDuplicates(["subject_cui", "object_cui", "relationship_type", "source_class", "edge"])


def _column(df: DataFrame, names: list[str]) -> Column | None:
    """The first of ``names`` that the table has, case aside."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[n.lower()] for n in names if n.lower() in have), None)
    return None if found is None else F.col(f"`{found}`")


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path: csv, tsv, json, jsonl or parquet (csv, tsv and jsonl also .gz)."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".csv", ".tsv", ".txt")):
        return spark.read.option("header", True).option("sep", "," if name.endswith(".csv") else "\t").option("escape", '"').option("multiLine", True).csv(path)
    if name.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    return spark.read.json(path) if name.endswith((".jsonl", ".ndjson")) else spark.read.parquet(path)


def tabular_corpus(spark: SparkSession, path: str, source: str, text_columns: list[str], id_columns: list[str], title_columns: list[str] = ()) -> DataFrame:
    """(doc_id, source, text, title) of a table with a header: text columns joined, rows without text dropped, the id
    from the source and the id columns, else from the file and the text."""
    df = table(spark, path)
    join = lambda names: T.clean_text(F.concat_ws(" ", *(c for n in names if (c := _column(df, [n])) is not None)))
    text = join(text_columns)
    parts = [c for n in id_columns if (c := _column(df, [n])) is not None]
    own = F.concat_ws("", *parts) if parts else F.lit("")
    name = F.when(own != "", ids.stable_id("DOC_", F.lit(source), *parts)).otherwise(ids.stable_id("DOC_", F.lit(source), F.input_file_name(), text))
    return df.select(name.alias("doc_id"), F.lit(source).alias("source"), text.alias("text"), join(title_columns).alias("title")).where("text <> ''")


def query_log(spark: SparkSession, path: str, source: str = "query_log", kind: str = "query") -> DataFrame:
    """Evidence of a query log with a header: query (or search, text), cui, source, evidence_type (or type), count (or
    frequency), weight. The weight is the count where it is not given. A row without query or cui ends the job."""
    df = table(spark, path)
    query, cui = _column(df, ["query", "search", "text"]), _column(df, ["cui"])
    if query is None or cui is None:
        raise ValueError("a query log needs a query and a cui column")
    given = lambda names, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default)) if (c := _column(df, names)) is not None else F.lit(default)
    count = given(["count", "frequency"], "1").cast("double")
    weight = F.coalesce(given(["weight"], None).cast("double"), count)
    must = lambda c, what: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.raise_error(F.lit(f"a row has no {what}"))).otherwise(F.trim(c))
    out = df.select(must(query, "query").alias("text"), must(cui, "cui").alias("cui"), given(["source"], source).alias("source"), given(["evidence_type", "type"], kind).alias("evidence_type"), weight.alias("weight"))
    return out.withColumn("evidence_id", ids.stable_id("EVID_", F.col("source"), F.col("cui"), F.col("text")))


def snippets(spark: SparkSession, path: str, source: str = "snippets") -> DataFrame:
    """Reviewed snippets: as a query log, with weight 1 where none is given."""
    return query_log(spark, path, source, "reviewed_snippet")


def pipe_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The named fields of a pipe-delimited release file without header or quoting; empty stands for missing."""
    parts = F.split("value", r"\|", -1)
    return spark.read.text(path).select(*(F.coalesce(F.get(parts, F.lit(at)), F.lit("")).alias(name) for name, at in PIPE_FIELDS[kind].items()))


def obo_terms(spark: SparkSession, path: str, obsolete: bool = False) -> DataFrame:
    """(term_id, name, definition, synonyms, xrefs, parents, relations, is_obsolete) of the [Term] stanzas of OBO text."""
    stanza = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").startswith("Term]") | F.col("value").startswith("[Term]"))
    body = F.concat(F.lit("\n"), F.col("value"), F.lit("\n"))
    one = lambda tag: F.nullif(F.trim(F.regexp_extract(body, rf"\n{tag}: ([^\n]*)", 1)), F.lit(""))
    many = lambda tag, form: F.regexp_extract_all(body, F.lit(rf"\n{tag}: {form}"), 1)
    quoted = r'"((?:[^"\\\\]|\\\\.)*)"'.replace("\\\\\\\\", "\\\\")
    terms = stanza.select(
        one("id").alias("term_id"), one("name").alias("name"), F.nullif(F.regexp_extract(body, rf"\ndef: {quoted}", 1), F.lit("")).alias("definition"),
        many("synonym", quoted).alias("synonyms"), many("xref", r"([^\s\n]+)").alias("xrefs"), many("is_a", r"([^\s\n]+)").alias("parents"), many("relationship", r"([^\s\n]+ [^\s\n]+)").alias("relations"),
        (F.coalesce(one("is_obsolete"), F.lit("")) == "true").alias("is_obsolete"),
    )
    return terms.where("term_id is not null" + ("" if obsolete else " and not is_obsolete"))


def pubtator(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, mentions) of annotation blocks: (pmid, title, abstract) and (pmid, start, end, mention, types, cui)."""
    block = spark.read.option("lineSep", "\n\n").text(path).withColumn("value", F.regexp_replace("value", r"^\n+|\n+$", "")).where("value <> ''")
    part = lambda tag: F.regexp_extract("value", rf"(?m)^\d+\|{tag}\|(.*)$", 1)
    docs = block.select(F.regexp_extract("value", r"^(\d+)\|", 1).alias("pmid"), part("t").alias("title"), part("a").alias("abstract"))
    line = block.select(F.explode(F.split("value", "\n")).alias("line")).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 6)
    return docs, line.select(F.col("f")[0].alias("pmid"), F.col("f")[1].cast("int").alias("start"), F.col("f")[2].cast("int").alias("end"), F.col("f")[3].alias("mention"), F.col("f")[4].alias("types"), F.regexp_replace(F.col("f")[5], "^UMLS:", "").alias("cui"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(topic, doc, grade) of relevance judgments: topic, iteration, document and grade, separated by blanks."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) >= 4).select(f[0].alias("topic"), f[2].alias("doc"), f[3].cast("int").alias("grade"))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, text) of XML topics <topic number="1"> with any fields inside."""
    t = spark.read.format("xml").option("rowTag", "topic").option("inferSchema", False).load(path)
    fields = [F.col(f"`{c}`").cast("string") for c in t.columns if c != "_number"]
    return t.select(F.col("_number").alias("topic"), T.clean_text(F.concat_ws(" ", *fields)).alias("text"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract, journal, year) of bulk citation XML, abstract sections joined, each behind its label, also
    where it has no text."""
    schema = "MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>>>"
    a = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path).select("MedlineCitation.*")
    sections = F.transform(F.coalesce("Article.Abstract.AbstractText", F.array()), lambda s: F.concat_ws(": ", s["_Label"], F.coalesce(s["_VALUE"], F.lit(""))))
    return a.select(F.col("PMID._VALUE").alias("pmid"), T.clean_text(F.col("Article.ArticleTitle")).alias("title"), T.clean_text(F.array_join(sections, " ")).alias("abstract"), F.col("Article.Journal.Title").alias("journal"), F.col("Article.Journal.JournalIssue.PubDate.Year").try_cast("int").alias("year"))


def trials(spark: SparkSession, path: str, outcomes_only: bool = False, require_results: bool = False) -> DataFrame:
    """(doc_id, title, text) of registered studies as nested JSON: summary, conditions and outcomes; ``outcomes_only``
    leaves the outcomes alone, ``require_results`` the studies that have results."""
    schema = """protocolSection struct<identificationModule: struct<nctId: string, briefTitle: string>, descriptionModule: struct<briefSummary: string>,
    conditionsModule: struct<conditions: array<string>>, outcomesModule: struct<primaryOutcomes: array<struct<measure: string, description: string>>>>, hasResults boolean"""
    studies = spark.read.schema(schema).option("multiLine", True).json(path)
    p = (studies.where("hasResults") if require_results else studies).select("protocolSection.*")
    outcomes = F.transform(F.coalesce("outcomesModule.primaryOutcomes", F.array()), lambda o: F.concat_ws(". ", o["measure"], o["description"]))
    text = F.concat_ws(" ", "descriptionModule.briefSummary", F.array_join(F.coalesce("conditionsModule.conditions", F.array()), "; "), F.array_join(outcomes, " "))
    text = F.array_join(outcomes, " ") if outcomes_only else text
    return p.select(F.col("identificationModule.nctId").alias("doc_id"), F.col("identificationModule.briefTitle").alias("title"), T.clean_text(text).alias("text"))


def pages(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with title and text of a column of HTML."""
    return df.select(*keep, T.html_to_text(F.col(html)).alias("p")).select(*keep, "p.title", "p.text")


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(cui, vector) of lines with a name and numbers, separated by blanks, tabs or commas; a header line of two numbers
    is skipped."""
    f = F.split(F.trim("value"), r"[\s,]+")
    return spark.read.text(path).where(F.size(f) > 2).select(f[0].alias("cui"), F.transform(F.slice(f, F.lit(2), F.size(f) - 1), lambda x: x.cast("double")).alias("vector"))


def object_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(cui, vector) of JSON objects of names and number lists. A file is read from bracket to bracket, not as a whole,
    so it may be of any size and is shared out among tasks."""
    part = spark.read.option("lineSep", "]").text(path)
    name = r'"((?:[^"\\\\]|\\\\.)*)"\s*:\s*\['.replace("\\\\", "\\")
    found = part.select(F.regexp_extract("value", name, 1).alias("cui"), F.regexp_replace("value", r"^[\s\S]*\[", "").alias("v")).where("cui <> ''")
    return found.select("cui", F.transform(F.split(F.trim("v"), r"\s*,\s*"), lambda x: x.cast("double")).alias("vector"))


def compact_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(metadata columns, vector) of vectors that ``sinks.compact_vectors`` wrote; a matrix that does not hold the rows
    and numbers its manifest names ends the job."""
    told = spark.read.json(f"{path}/manifest").first()
    block, dims = told.block, told.dims

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, data in zip(b["block"], b["matrix"], strict=True):
                if len(data) % (4 * dims):
                    raise ValueError(f"block {at} does not hold vectors of {dims} numbers")
                m = np.frombuffer(data, "<f4").reshape(-1, dims)
                yield pd.DataFrame({"pos": np.arange(len(m)) + at * block, "vector": list(m)})

    vectors = spark.read.parquet(f"{path}/matrix").mapInPandas(unpack, "pos long, vector array<float>")
    return spark.read.json(f"{path}/metadata").join(vectors, "pos").drop("pos")


def semantic_types(spark: SparkSession, path: str) -> DataFrame:
    """(cui, tui, stn, sty, atui), each concept's types once."""
    t = pipe_file(spark, path, "types").where("cui <> '' and tui <> ''")
    return t.groupBy("cui", "tui").agg(F.min("stn").alias("stn"), F.min("sty").alias("sty"), F.min("atui").alias("atui"))


def concepts_of_types(types: DataFrame, wanted: list[str]) -> DataFrame:
    """(cui) of the concepts one of whose types is wanted by its number or, case aside, its name."""
    low = [w.lower() for w in wanted]
    return types.where(F.lower("tui").isin(low) | F.lower("sty").isin(low)).select("cui").distinct()


def _plain(xml: Column) -> Column:
    """Text of a piece of XML: tags off, entities resolved, white space collapsed."""
    s = F.regexp_replace(xml, r"<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(sign))
    return T.clean_text(s)


def _elements(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)


def _xml_rows(spark: SparkSession, path: str, row: str, fields: list[str]) -> DataFrame:
    """Elements ``row`` with their attributes and children as they are written."""
    return spark.read.format("xml").option("rowTag", row).schema(", ".join(f"`{f}` string" for f in fields)).load(path)


def _cut_back(text: Column, most: int) -> Column:
    """The text up to ``most`` signs, cut back to the last blank."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", ""))


def full_texts(spark: SparkSession, path: str, most: int = 200_000) -> DataFrame:
    """(doc_id, title, text, license) of full-text articles: abstract, then titles and paragraphs of the body."""
    a = _xml_rows(spark, path, "article", ["front", "body"])
    body = F.transform(F.regexp_extract_all("body", F.lit(r"(?s)<(?:title|p)(?:\s[^>]*)?>(.*?)</(?:title|p)>"), 1), _plain)
    text = F.trim(F.array_join(F.concat(F.transform(_elements(F.col("front"), "abstract"), _plain), F.coalesce(body, F.array())), " "))
    first = lambda tag: _plain(F.get(_elements(F.col("front"), tag), F.lit(0)))
    return a.select(first("article-id").alias("doc_id"), first("article-title").alias("title"), _cut_back(text, most).alias("text"), first("license").alias("license"))


def health_topics(spark: SparkSession, path: str, spanish: bool = False) -> DataFrame:
    """(doc_id, title, text, synonyms, groups) of topic pages; Spanish ones are skipped unless wanted."""
    t = spark.read.format("xml").option("rowTag", "health-topic").schema("_id string, _title string, _language string, `full-summary` string, `also-called` array<string>, `group` array<string>").load(path)
    t = t if spanish else t.where(F.coalesce(F.lower("_language"), F.lit("english")) != "spanish")
    names = lambda c: F.transform(F.coalesce(F.col(f"`{c}`"), F.array()), T.clean_text)
    return t.select(F.col("_id").alias("doc_id"), F.col("_title").alias("title"), _plain(F.col("`full-summary`")).alias("text"), names("also-called").alias("synonyms"), names("group").alias("groups"))


def genetics_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text, related) of genetics summaries with their related conditions."""
    g = _xml_rows(spark, path, "summary", ["name", "key", "text-list", "related-list"])
    related = F.transform(_elements(F.col("`related-list`"), "name"), _plain)
    return g.select(F.trim("key").alias("doc_id"), F.trim("name").alias("title"), _plain(F.col("`text-list`")).alias("text"), F.coalesce(related, F.array()).alias("related"))


# Sections of a drug label that say what it is for and what it does.
LABEL_SECTIONS = ["indications", "contraindications", "warnings", "adverse reactions", "dosage"]


def drug_labels(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """(doc_id, title, text) of drug labels, relevant sections only, one document a set."""
    d = _xml_rows(spark, path, "document", ["setId", "title", "component"])
    section = F.regexp_extract_all("component", F.lit(r"(?s)<section(?:\s[^>]*)?>(.*?)</section>"), 1)
    head = lambda x: F.lower(_plain(F.get(_elements(x, "title"), F.lit(0))))
    wanted = F.filter(section, lambda x: F.exists(F.array(*map(F.lit, LABEL_SECTIONS)), lambda n: head(x).contains(n)))
    text = _cut_back(F.array_join(F.transform(wanted, _plain), " "), most)
    one = d.select(F.trim("setId").alias("doc_id"), _plain(F.col("title")).alias("title"), text.alias("text")).where("text <> ''")
    return one.groupBy("doc_id").agg(F.min(F.struct("title", "text")).alias("x")).select("doc_id", "x.title", "x.text")


def book_archives(spark: SparkSession, path: str, least: int = 1, most: int = 200_000) -> DataFrame:
    """(doc_id, title, text, license) of the chapters in tar archives of book XML; tables of contents are skipped. An
    archive is opened by one task, its chapters one by one."""

    def chapters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        if member.isfile() and member.name.lower().endswith((".nxml", ".xml")) and "toc" not in member.name.lower().rsplit("/", 1)[-1]:
                            yield pd.DataFrame({"name": [member.name], "xml": [archive.extractfile(member).read().decode("utf-8", "replace")]})

    x = spark.read.format("binaryFile").load(path).select("content").mapInPandas(chapters, "name string, xml string")
    first = lambda tag: _plain(F.coalesce(F.get(_elements(F.col("xml"), tag), F.lit(0)), F.lit("")))
    body = F.array_join(F.transform(F.regexp_extract_all("xml", F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), 1), _plain), " ")
    d = x.select(F.regexp_replace("name", r"^.*/|\.n?xml$", "").alias("doc_id"), first("title").alias("title"), _cut_back(body, most).alias("text"), first("license").alias("license"))
    return d.where(F.length("text") >= least)


def page_specs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, cui, text, relations) of specifications of pages: title, extract and named relations to other concepts."""
    schema = "cui string, title string, extract string, relations array<struct<name: string, target: string>>"
    d = jsonl(spark, path, schema).where("cui is not null and coalesce(trim(extract), '') <> ''")
    lines = F.transform(F.coalesce("relations", F.array()), lambda r: F.concat_ws(" ", r["name"], r["target"]))
    return d.select(F.concat(F.col("cui"), F.lit(":page")).alias("doc_id"), "cui", T.clean_text(F.concat_ws(". ", "title", "extract")).alias("text"), lines.alias("relations"))


def relation_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, kind, subject_type, subject, object_type, object) of tab-separated relations between ``type|id`` pairs; a
    line of another form ends the job."""
    f = F.split("value", "\t")
    pair = r"^([A-Za-z]+)\|(.+)$"
    good = (F.size(f) >= 4) & F.get(f, F.lit(2)).rlike(pair) & F.get(f, F.lit(3)).rlike(pair)
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.when(F.coalesce(good, F.lit(False)), f).otherwise(F.raise_error(F.concat(F.lit("no relation: "), "value"))).alias("f"))
    side = lambda i, g: F.regexp_extract(F.col("f")[i], pair, g)
    return lines.select(F.col("f")[0].alias("pmid"), F.lower(F.col("f")[1]).alias("kind"), F.lower(side(2, 1)).alias("subject_type"), side(2, 2).alias("subject"), F.lower(side(3, 1)).alias("object_type"), side(3, 2).alias("object"))


def delimited_topics(spark: SparkSession, path: str, sep: str = ":") -> DataFrame:
    """(topic, text) of lines with a number, a separator and the text."""
    at = rf"^\s*(\w+)\s*{re.escape(sep)}\s*(\S.*)$"
    return spark.read.text(path).where(F.col("value").rlike(at)).select(F.regexp_extract("value", at, 1).alias("topic"), T.clean_text(F.regexp_extract("value", at, 2)).alias("text"))


def tagged_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, text) of <top> blocks whose fields open with a tag and need not close it: number, title, description."""
    block = spark.read.option("lineSep", "<top>").text(path).where(F.col("value").contains("<num>"))
    field = lambda tag: F.regexp_replace(F.regexp_extract("value", rf"(?s)<{tag}>\s*(?:\w+:)?\s*(.*?)\s*(?=<|$)", 1), r"\s+", " ")
    return block.select(field("num").alias("topic"), T.clean_text(F.concat_ws(" ", F.nullif(field("title"), F.lit("")), F.nullif(field("desc"), F.lit("")))).alias("text"))
