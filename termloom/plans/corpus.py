"""Mention and corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import corpus as C
from termloom.operators import mentions as M
from termloom.session import table

CONDITIONS = ["migraine", "epilepsy", "asthma", "sciatica", "gout", "psoriasis", "anemia", "insomnia", "cystitis", "pneumonia", "glaucoma", "eczema", "hypertension", "osteoporosis", "hepatitis", "heart failure", "celiac disease", "type 2 diabetes"]


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return M.plan_chunks(table(spark, sf, "documents", "doc_id", "text"), ["doc_id"], "text")


def doc_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    return M.find_abbreviations(table(spark, sf, "documents", "doc_id", "text"), ["doc_id"], "text")


def portal_assertions(spark: SparkSession, sf: str) -> DataFrame:
    return M.assert_mentions(table(spark, sf, "search_quality_patient_portal_queries", "row_id", "query"), ["row_id"], "query", CONDITIONS)


def evidence_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The words around "patients" in each piece of evidence."""
    e = table(spark, sf, "evidence", "row_id", "text")
    return e.select("row_id", M.snippet(F.col("text"), F.lit("patients"), 20).alias("snippet")).where("snippet is not null")


def edges_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Seven edges of each source, evenly spread over its edges."""
    return M.spread(table(spark, sf, "relationship_edges", "row_id", "source_cui"), ["source_cui"], ["row_id"], 7)


def docs_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a pass in order of id keeps, dropping those that share a long title or a text with a kept one."""
    d = table(spark, sf, "documents", "doc_id", "title", "text").where("length(text) > 0")
    keys = F.concat(C.identity_keys(d), F.array(F.concat(F.lit("text:"), F.md5("text"))))
    return C.merge_first_wins(d, keys, "doc_id").select("doc_id")


def docs_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the later half whose text the earlier half does not have."""
    d = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    half = (d.agg(F.max("doc_id")).first()[0] or 0) / 2
    key = F.array(F.md5("text"))
    return C.without_known(d.where(F.col("doc_id") >= half), key, d.where(F.col("doc_id") < half).select(F.md5("text").alias("k"))).select("doc_id")


def evidence_public(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts all of whose sources may be shown, with their public label."""
    e = table(spark, sf, "evidence", "cui", "source").groupBy("cui").agg(F.collect_set(F.coalesce(F.lower(F.trim("source")), F.lit(""))).alias("sources"))
    pub = table(spark, sf, "labels", "cui", "label", "suppress").where("suppress = 'N' and label is not null").groupBy("cui").agg(F.min("label").alias("public"))
    seen = C.public_view(e.join(pub, "cui", "left"), F.col("sources"), ["pubmed", "query_log", "europepmc", "snippets", "textbook"], F.col("cui"), F.col("public"))
    return seen.select("cui", "display")


def label_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Why label rows would be pruned, counted."""
    low = F.lower(F.trim("label"))
    rules = {"no_label": F.col("label").isNull() | (low == ""), "suppressed": F.col("suppress") != "N", "long": F.length("label") > 60, "number": low.rlike("^[0-9. ]+$")}
    return C.drop_reasons(table(spark, sf, "labels", "label", "suppress"), rules).groupBy("drop_reason").agg(F.count("*").alias("n"))


def evidence_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence", "row_id", "text").select("row_id", C.blake_hash(F.col("text")).alias("h"))


def view_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts by the first bucket that one of their views belongs to."""
    v = table(spark, sf, "evidence", "cui", "view").groupBy("cui").agg(F.collect_set("view").alias("views"))
    return v.groupBy(C.first_bucket(F.col("views"), {"therapy": ["drug"], "meaning": ["definition"], "people": ["patient"]}).alias("bucket")).agg(F.count("*").alias("n"))


def run_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Event types as lanes: mean value, weighted by how often; capped if two of three lanes are low."""
    lanes = table(spark, sf, "events", "event_type", "value").groupBy(F.col("event_type").alias("lane")).agg(F.avg("value").alias("score"), F.count("*").cast("double").alias("weight"))
    caps = spark.createDataFrame([("use", x, 1000.0, 2, 15.0) for x in ("view", "click", "purchase")] + [("faults", "error", 0.0, 1, 1.0)], "cap string, lane string, below double, enough int, max_score double")
    s = C.scorecard(lanes, caps)
    return s.select(F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (doc_chunks, doc_abbreviations, portal_assertions, evidence_snippets, edges_spread, docs_merged, docs_unseen, evidence_public, label_prune, evidence_hashes, view_buckets, run_scorecard)}

SQL = {
    "evidence_snippets": "select row_id, substr(text, greatest(p - 20, 1), 8 + 20 + least(p - 1, 20)) as snippet from (select row_id, text, instr(lower(text), 'patients') as p from evidence) where p > 0",
    "edges_spread": "select row_id, source_cui from (select row_id, source_cui, row_number() over (partition by source_cui order by row_id) - 1 as i, count(*) over (partition by source_cui) as n from relationship_edges) where n <= 7 or list_contains(list_transform(range(0, 7), lambda k: cast(round_even(k * (n - 1) / 6, 0) as bigint)), i)",
    "docs_unseen": "select doc_id from documents where text is not null and doc_id >= (select max(doc_id) / 2.0 from documents where text is not null) and md5(text) not in (select md5(text) from documents where text is not null and doc_id < (select max(doc_id) / 2.0 from documents where text is not null))",
    "evidence_public": """with e as (select cui, list_distinct(list(coalesce(lower(trim(source)), ''))) as s from evidence group by cui), p as (select cui, min(label) as public from labels where suppress = 'N' and label is not null group by cui)
select cui, public as display from e join p using (cui) where len(list_filter(s, lambda x: x not in ('pubmed', 'query_log', 'europepmc', 'snippets', 'textbook'))) = 0""",
    "label_prune": "select case when label is null or trim(label, ' ') = '' then 'no_label' when suppress <> 'N' then 'suppressed' when length(label) > 60 then 'long' when regexp_full_match(lower(trim(label, ' ')), '[0-9. ]+') then 'number' else '' end as drop_reason, count(*) as n from labels group by 1",
    "view_buckets": "select case when list_contains(v, 'drug') then 'therapy' when list_contains(v, 'definition') then 'meaning' when list_contains(v, 'patient') then 'people' else 'OTHER' end as bucket, count(*) as n from (select cui, list(distinct view) as v from evidence group by cui) group by 1",
    "run_scorecard": """with l as (select event_type as lane, avg(value) as score, count(*) as weight from events group by 1), r as (select sum(weight * score) / sum(weight) as raw from l)
select round(raw, 6) as raw, round(case when (select count(*) from l where lane in ('view', 'click', 'purchase') and score < 1000) >= 2 then least(raw, 15.0::double) else raw end, 6) as score from r""",
}
