"""Dictionary and evidence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import ids
from termloom.functions import text as T
from termloom.operators import dictionary as D
from termloom.operators import evidence as E
from termloom.operators.packed import unpack
from termloom.plans.text import PACKED, _values_sql, key_sql, toks_sql
from termloom.session import as_integer, table

#: What the string-search queries look for, by mode.
SEARCHED = {"exact": "chronic rectum infarction", "words": "infarction rectum", "normalizedWords": "infarctions rectums", "normalizedString": "Chronic-Rectum INFARCTION", "leftTruncation": "tissue 7", "rightTruncation": "chronic"}


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels")


def _search(mode: str, partial: bool = False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return D.search_labels(table(spark, sf, "labels", "row_id", "cui", "label"), SEARCHED[mode], mode, partial).select("row_id", "cui", "label")

    return run


def label_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows each visibility setting shows, by source."""
    s = F.col("suppress")
    modes = {"strict": D.visible(s), "obsolete": D.visible(s, True), "suppressible": D.visible(s, False, True), "all": D.visible(s, True, True)}
    return table(spark, sf, "labels", "sab", "suppress").groupBy("sab").agg(*(F.count_if(c).alias(n) for n, c in modes.items()))


def label_preferred(spark: SparkSession, sf: str) -> DataFrame:
    return D.best_rows(_labels(spark, sf), ["cui"])


def label_best_by_code(spark: SparkSession, sf: str) -> DataFrame:
    return D.best_rows(_labels(spark, sf), ["cui", "sab"])


def label_top3(spark: SparkSession, sf: str) -> DataFrame:
    return D.labels_per_concept(_labels(spark, sf), 3)


def label_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts per key, the lowest of them, and whether a linker that allows two may take it."""
    keyed = table(spark, sf, "labels", "label", "cui").select(T.normalized_key(F.col("label")).alias("key"), "cui").where("key <> ''")
    return keyed.groupBy("key").agg(F.countDistinct("cui").alias("n_cuis"), F.min("cui").alias("lowest")).withColumn("linkable", F.col("n_cuis") <= 2)


def label_retired(spark: SparkSession, sf: str) -> DataFrame:
    """Concept and source pairs of the first half of the load that the second half no longer has."""
    rows = table(spark, sf, "labels", "row_id", "cui", "sab")
    half = rows.agg(F.max("row_id")).first()[0] or 0
    old, new = rows.where(F.col("row_id") * 2 < half), rows.where(F.col("row_id") * 2 >= half)
    return old.select("cui", "sab").distinct().join(new.select("cui", "sab").distinct(), ["cui", "sab"], "left_anti")


def label_of_target(spark: SparkSession, sf: str) -> DataFrame:
    """Display label of each relation's target: its preferred label, else the relation's own, else the id."""
    best = D.best_rows(_labels(spark, sf), ["cui"]).select(F.col("cui").alias("target_cui"), F.col("label").alias("preferred"))
    rel = table(spark, sf, "related_concepts", "row_id", "target_cui", "label")
    return rel.join(best, "target_cui", "left").select("row_id", F.coalesce("preferred", "label", "target_cui").alias("display"))


def term_codes(spark: SparkSession, sf: str) -> DataFrame:
    """(system, code, cui) of the codes that the hierarchy's terms are known by."""
    o = table(spark, sf, "obo_terms", "term_id", "xrefs").select(F.upper(F.regexp_extract("term_id", r"^\s*([A-Za-z]+)[:_]", 1)).alias("system"), F.regexp_extract("term_id", r"[:_]([0-9]+)", 1).alias("code"), F.explode("xrefs").alias("x"))
    return o.select("system", "code", F.upper(F.regexp_extract("x", r"\b([Cc][0-9]{7})\b", 1)).alias("cui")).where("system <> '' and code <> '' and cui <> ''").distinct()


def resolve_values(spark: SparkSession, sf: str) -> DataFrame:
    """Packed portal values to concepts: an identifier of the dictionary scores 100, a code of a named system that a term
    is known by 96, a label 88; the best per row, field and target. A code that no term has stays as it is, with score 0."""
    v = unpack(table(spark, sf, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED)
    known = table(spark, sf, "labels", "cui").distinct()
    head = F.upper(F.regexp_extract("val", r"^([A-Za-z]\d{7})", 1))
    by_id = v.withColumn("target", head).join(known.withColumnRenamed("cui", "target"), "target").select("row_id", "field", "target", F.lit(100).alias("score"))
    code = ids.system_code(F.col("val"))
    coded = v.withColumn("c", code).where("c is not null").select("row_id", "field", F.concat_ws(":", "c.system", "c.code").alias("written"))
    by_code = coded.join(term_codes(spark, sf).select(F.concat_ws(":", "system", "code").alias("written"), "cui"), "written", "left").select("row_id", "field", F.coalesce("cui", "written").alias("target"), F.when(F.col("cui").isNull(), 0).otherwise(96).alias("score"))
    names = table(spark, sf, "labels", "label", "cui").select(T.normalized_key(F.col("label")).alias("key"), "cui").where("key <> ''").distinct()
    by_name = v.withColumn("key", T.normalized_key(F.element_at(F.split("val", "="), -1))).where(F.col("val").contains("=")).join(names, "key").select("row_id", "field", F.col("cui").alias("target"), F.lit(88).alias("score"))
    return by_id.unionByName(by_code).unionByName(by_name).groupBy("row_id", "field", "target").agg(F.max("score").alias("score"))


def evidence_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "evidence", "row_id", "source", "evidence_type")
    return E.keep(e, {"source": ["pubmed", "query_log"]}, {"evidence_type": ["definition"]}).select("row_id")


def evidence_views(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence", "evidence_type").groupBy(E.view_of(F.col("evidence_type")).alias("view")).agg(F.count("*").alias("n"))


def query_log_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregated query log to evidence: weight is the number of users, 1 where it is unknown; empty terms drop."""
    q = table(spark, sf, "query_rows", "search_term", "unique_users").where(F.trim("search_term") != "")
    key = T.normalized_key(F.col("search_term"))
    return q.groupBy(key.alias("term")).agg(F.sum(F.coalesce("unique_users", F.lit(1))).cast("long").alias("weight"), F.count("*").alias("rows")).where("term <> ''")


def concept_docs_agg(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "evidence", "cui", "view", "weight", "source")
    return e.groupBy("cui", "view").agg(F.count("*").alias("evidence_count"), F.round(F.sum(F.coalesce("weight", F.lit(1.0))), 4).alias("weight"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def concept_docs_topk(spark: SparkSession, sf: str) -> DataFrame:
    return E.top_texts(table(spark, sf, "evidence"), 12).select("cui", "view", "place", "text", F.round("weight", 6).alias("weight"))


def concept_docs_text(spark: SparkSession, sf: str) -> DataFrame:
    labels = D.labels_per_concept(_labels(spark, sf), 8).groupBy("cui").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("labels"))
    return E.concept_documents(table(spark, sf, "evidence"), labels, 12)


def concept_docs_bullets(spark: SparkSession, sf: str) -> DataFrame:
    return E.parse_bullets(concept_docs_text(spark, sf))


def provenance_topn(spark: SparkSession, sf: str) -> DataFrame:
    return E.first_sources(table(spark, sf, "evidence"), 3).select("cui", "view", "text_hash", "rank", "source", "evidence_id")


def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "evidence", "source").groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    return e.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def definitions_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions of each term, equal ones once (the first), the three shortest."""
    d = table(spark, sf, "obo_terms", "row_id", "term_id", "definition").where("definition is not null").withColumn("key", T.normalized_key(F.col("definition")))
    once = d.groupBy("term_id", "key").agg(F.min_by("definition", "row_id").alias("definition"))
    place = F.row_number().over(Window.partitionBy("term_id").orderBy(F.length("definition"), F.lower("definition"), "key"))
    return once.withColumn("place", place).where("place <= 3").select("term_id", "place", "definition")


def evidence_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence keyed by id, later rows replacing earlier ones."""
    e = table(spark, sf, "evidence", "evidence_id", "row_id", "cui")
    return e.groupBy("evidence_id").agg(F.max("row_id").alias("row_id"), F.max_by("cui", "row_id").alias("cui"))


QUERIES = {f"label_{m[0].lower() + m[1:]}": _search(m) for m in D.MODES} | {"label_words_partial": _search("words", True)}
QUERIES |= {
    f.__name__: f
    for f in (label_visibility, label_preferred, label_best_by_code, label_top3, label_ambiguity, label_retired, label_of_target, resolve_values, evidence_filter, evidence_views, query_log_ingest, concept_docs_agg, concept_docs_topk, concept_docs_text, concept_docs_bullets, provenance_topn, source_mix, definitions_topk, evidence_upsert)
}

_PLACE = "case " + " ".join(f"when tty = '{t}' then {i}" for i, t in enumerate(D.TERM_TYPES, 1)) + " else 99 end"
_ORDER = f"case when suppress = 'N' then 0 else 1 end, case when ispref = 'Y' then 0 else 1 end, {_PLACE}, length(label), label, row_id"
_ROW = "select row_id, cui, label from labels where label is not null and "
_TOP = f"""select cui, view, row_number() over (partition by cui, view order by weight desc, text, evidence_id, row_id) as place, text, weight from
(select cui, view, text, coalesce(weight, 1) as weight, evidence_id, row_id from evidence where text is not null qualify row_number() over (partition by cui, view, {key_sql('text')} order by coalesce(weight, 1) desc, text, evidence_id, row_id) = 1) qualify place <= 12"""


def _stems(c: str) -> str:
    return f"list_transform({toks_sql(c)}, lambda x: case when x like '%s' and length(x) > 4 and not regexp_matches(x, '(ss|us|is|ies|ves)$') and x not in ('diabetes', 'herpes', 'rabies', 'always', 'series') then left(x, length(x) - 1) else x end)"


def _has(c: str, words: list[str], any_of: bool = False) -> str:
    return (" or " if any_of else " and ").join(f"list_contains({c}, '{w}')" for w in words)


_CODES = r"""co as (select distinct * from (select upper(regexp_extract(term_id, '^\s*([A-Za-z]+)[:_]', 1)) as system, regexp_extract(term_id, '[:_]([0-9]+)', 1) as code, upper(regexp_extract(unnest(xrefs), '\b([Cc][0-9]{7})\b', 1)) as cui from obo_terms) where system <> '' and code <> '' and cui <> '')"""

SQL = {
    "label_exact": _ROW + "lower(trim(label, ' ')) = 'chronic rectum infarction'",
    "label_words": _ROW + _has(toks_sql("label"), ["infarction", "rectum"]),
    "label_words_partial": _ROW + "(" + _has(toks_sql("label"), ["infarction", "rectum"], True) + ")",
    "label_normalizedWords": _ROW + _has(_stems("label"), ["infarction", "rectum"]),
    "label_normalizedString": _ROW + f"{key_sql('label')} = 'chronic rectum infarction'",
    "label_leftTruncation": _ROW + "ends_with(lower(trim(label, ' ')), 'tissue 7')",
    "label_rightTruncation": _ROW + "starts_with(lower(trim(label, ' ')), 'chronic')",
    "label_visibility": "select sab, count(*) filter (suppress = 'N') as strict, count(*) filter (suppress in ('N', 'O')) as obsolete, count(*) filter (suppress in ('N', 'E', 'Y')) as suppressible, count(*) filter (suppress in ('N', 'O', 'E', 'Y')) as \"all\" from labels group by sab",
    "label_preferred": f"select cui, row_id, label from labels where label is not null qualify row_number() over (partition by cui order by {_ORDER}) = 1",
    "label_best_by_code": f"select cui, sab, row_id, label from labels where label is not null qualify row_number() over (partition by cui, sab order by {_ORDER}) = 1",
    "label_top3": f"""with o as (select *, lower(label) as low from labels where label is not null qualify row_number() over (partition by cui, lower(label) order by {_ORDER}) = 1)
select cui, row_number() over (partition by cui order by {_ORDER}) as place, label from o qualify place <= 3""",
    "label_ambiguity": f"select key, count(distinct cui) as n_cuis, min(cui) as lowest, count(distinct cui) <= 2 as linkable from (select {key_sql('label')} as key, cui from labels) where key <> '' group by key",
    "label_retired": """with h as (select max(row_id) as m from labels) select distinct cui, sab from labels a, h where row_id * 2 < m and not exists (select 1 from labels b, h where b.row_id * 2 >= h.m and a.cui = b.cui and a.sab = b.sab)""",
    "label_of_target": f"""with p as (select cui, label from labels where label is not null qualify row_number() over (partition by cui order by {_ORDER}) = 1)
select r.row_id, coalesce(p.label, r.label, r.target_cui) as display from related_concepts r left join p on p.cui = r.target_cui""",
    "resolve_values": f"""with {_CODES}, v as ({_values_sql()}), k as (select distinct cui from labels), n as (select distinct {key_sql('label')} as key, cui from labels),
u as (select row_id, field, upper(regexp_extract(val, '^([A-Za-z][0-9]{{7}})', 1)) as target, 100 as score from v where upper(regexp_extract(val, '^([A-Za-z][0-9]{{7}})', 1)) in (select cui from k)
union all select row_id, field, coalesce(co.cui, w.written), case when co.cui is null then 0 else 96 end from (select row_id, field, case when regexp_matches(upper(val), '^SNO:') then 'SNOMEDCT_US' else upper(split_part(val, ':', 1)) end || ':' || trim(regexp_extract(val, '{ids.SYSTEM_CODE}', 2)) as written from v where regexp_matches(val, '{ids.SYSTEM_CODE}')) w left join co on co.system || ':' || co.code = w.written
union all select v.row_id, v.field, n.cui, 88 from v join n on n.key = {key_sql("string_split(val, '=')[-1]")} where contains(val, '=') and n.key <> '')
select row_id, field, target, max(score) as score from u group by all""",
    "evidence_filter": "select row_id from evidence where source in ('pubmed', 'query_log') and (evidence_type is null or evidence_type <> 'definition')",
    "evidence_views": "select case when evidence_type = 'query_log' then 'query_language' when evidence_type = 'snippet' then 'prose_evidence' when coalesce(evidence_type, '') = '' then 'evidence' else lower(evidence_type) end as view, count(*) as n from evidence group by 1",
    "query_log_ingest": f"select {key_sql('search_term')} as term, cast(sum(coalesce(unique_users, 1)) as bigint) as weight, count(*) as rows from query_rows where trim(search_term) <> '' group by 1 having term <> ''",
    "concept_docs_agg": "select cui, view, count(*) as evidence_count, round(sum(coalesce(weight, 1)), 4) as weight, coalesce(string_agg(distinct source, ',' order by source), '') as sources from evidence group by cui, view",
    "concept_docs_topk": _TOP.replace("place, text, weight from", "place, text, round(weight, 6) as weight from", 1),
    "provenance_topn": """with o as (select cui, view, sha256(text) as text_hash, coalesce(source, '') as source, min(row_id) as row_id, arg_min(evidence_id, row_id) as evidence_id from evidence where text is not null group by all)
select cui, view, text_hash, row_number() over (partition by cui, view, text_hash order by row_id) as rank, source, evidence_id from o qualify rank <= 3""",
    "source_mix": "select coalesce(lower(trim(source)), 'unknown') as source, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from evidence group by 1",
    "definitions_topk": f"""with o as (select term_id, {key_sql('definition')} as key, arg_min(definition, row_id) as definition from obo_terms where definition is not null group by all)
select term_id, row_number() over (partition by term_id order by length(definition), lower(definition), key) as place, definition from o qualify place <= 3""",
    "evidence_upsert": "select evidence_id, max(row_id) as row_id, arg_max(cui, row_id) as cui from evidence group by evidence_id",
}
SQL = as_integer(SQL, {"label_top3": "place", "concept_docs_topk": "place", "provenance_topn": "rank", "definitions_topk": "place"})
