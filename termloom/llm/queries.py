"""Queries of the operators in this package, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.leaks import find_leaks
from termloom.llm.mixing import mix, token_counts
from termloom.llm.neighbors import nearest, usable
from termloom.llm.personal import find_items, redact
from termloom.llm.pieces import split_pieces
from termloom.llm.sentences import split_sentences
from termloom.llm.topn import top_n
from termloom.llm.variants import canonical_key, collapse
from termloom.session import as_integer, table

def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    portal = table(spark, sf_dir, "search_quality_patient_portal_queries", "row_id", "query").select(F.lit("search_quality_patient_portal_queries").alias("tbl"), "row_id", F.col("query").alias("text"))
    terms = table(spark, sf_dir, "query_rows", "row_id", "search_term").select(F.lit("query_rows").alias("tbl"), "row_id", F.col("search_term").alias("text"))
    return portal.unionByName(terms)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(_texts(spark, sf_dir)).select("tbl", "row_id", "kind").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return redact(texts, find_items(texts))


_LABEL = ["cui", "sab", "tty", "ispref", "suppress"]
_EVIDENCE = ["cui", "view", "evidence_type"]


def _collapsed(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    out = {}
    for name, exact, field in (("labels", _LABEL, "label"), ("evidence", _EVIDENCE, "norm_text")):
        rows = table(spark, sf_dir, name, "row_id", *exact, field)
        out[name] = collapse(rows, "row_id", canonical_key([F.col(c) for c in exact], F.col(field)))
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (m.select(F.lit(t).alias("tbl"), F.col("record").alias("row_id"), F.col("row_id").alias("copy_row_id")) for t, (_, m) in _collapsed(spark, sf_dir).items())
    return a.unionByName(b)


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record, the smallest row of its copies, and how many copies it has."""
    a, b = (r.select(F.lit(t).alias("tbl"), "row_id", "n_copies") for t, (r, _) in _collapsed(spark, sf_dir).items())
    return a.unionByName(b)


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(usable(table(spark, sf_dir, "vector_records", "row_id", "doc_id", "vector"), "row_id", "vector", 64, "doc_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select(F.least("row_id", "neighbor").alias("row_id_a"), F.greatest("row_id", "neighbor").alias("row_id_b")).distinct()


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest concept vectors of each usable record, in the shape of external_cui_neighbors."""
    names = table(spark, sf_dir, "vector_records", "row_id", "cui")
    found = _nearest(spark, sf_dir).join(names.select(F.col("row_id").alias("neighbor"), F.col("cui").alias("target_cui")), "neighbor")
    return found.join(names.select("row_id", F.col("cui").alias("source_cui")), "row_id").select("row_id", "source_cui", "target_cui", "score", "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("n_pieces > 1").select("row_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pieces(table(spark, sf_dir, "long_document_chunks", "row_id", "doc_id", "section", "text"), "row_id", "text", ["doc_id", "section"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _best(spark, sf_dir)
    return a.select("tbl", "row_id").unionByName(b.select("tbl", "row_id"))


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _best(spark, sf_dir)
    return a.unionByName(b)


def _best(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    concepts = table(spark, sf_dir, "related_concepts", "row_id", "source_cui", "target_cui", "rank")
    edges = table(spark, sf_dir, "relationship_edges", "row_id", "source_cui", "target_cui", "strength")
    cols = ["tbl", "source_cui", "top_rank", "row_id", "target_cui"]
    a = top_n(concepts, "source_cui", F.col("rank"), ["target_cui", "row_id"], 5).withColumn("tbl", F.lit("related_concepts"))
    b = top_n(edges, "source_cui", -F.col("strength"), ["target_cui", "row_id"], 5).withColumn("tbl", F.lit("relationship_edges"))
    return a.select(*cols), b.select(*cols)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "eval_items", "item_id", "text"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("longest >= 10").select("doc_id", "item_id").distinct()


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a run of ten words of an item, or, reordered or edited, half of its words in tiles."""
    found = _leaks(spark, sf_dir).withColumn("coverage", F.round(F.col("covered") / F.col("item_words"), 6))
    return found.where("longest >= 10 or coverage >= 0.5")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").where("text is not null").select("doc_id", "source", token_counts(F.col("text")).alias("n_tokens"))
    return mix(docs, "doc_id", "source", "n_tokens", table(spark, sf_dir, "source_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p1_redacted": p1_redacted,
    "p2_found": p2_found, "p2_records": p2_records, "p3_found": p3_found, "p3_neighbors": p3_neighbors, "p5_found": p5_found, "p5_pieces": p5_pieces,
    "p6_found": p6_found, "p6_ranked": p6_ranked, "p8_found": p8_found, "p8_coverage": p8_coverage, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found,
}

_TOP = """select '{t}' as tbl, source_cui, row_number() over (partition by source_cui order by {s}, target_cui, row_id) as top_rank, row_id, target_cui
from {t} where {f} is not null and not isnan(cast({f} as double)) and source_cui is not null qualify top_rank <= 5"""
_BEST = _TOP.format(t="related_concepts", s="rank", f="rank") + " union all " + _TOP.format(t="relationship_edges", s="strength desc", f="strength")

SQL = {
    "p3_found": """with u as (select min(row_id) as row_id, arg_min(v, row_id) as v from (select row_id, doc_id, cast(vector as double[]) as v from vector_records
  where len(vector) = 64 and len(list_filter(vector, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0)
  group by coalesce('d' || doc_id, 'r' || row_id)),
r as (select a.row_id as a, b.row_id as b from u a join u b on a.row_id <> b.row_id qualify row_number() over (partition by a.row_id order by list_cosine_similarity(a.v, b.v) desc, b.row_id) <= 5)
select distinct least(a, b) as row_id_a, greatest(a, b) as row_id_b from r""",
    "p5_found": "select row_id from long_document_chunks where len(regexp_extract_all(text, '[A-Za-z0-9]+')) > 95",
    "p6_found": f"select tbl, row_id from ({_BEST})",
    "p6_ranked": _BEST,
    "p8_found": r"""with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}\p{Nl}\p{No}]+'), lambda x: x <> '') as w from documents where text is not null),
i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}\p{Nl}\p{No}]+'), lambda x: x <> '') as w from eval_items where text is not null),
g as (select distinct item_id, array_to_string(w[k:k + 9], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 8)) as k from i)),
e as (select distinct doc_id, array_to_string(w[k:k + 9], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 8)) as k from d))
select distinct doc_id, item_id from e join g using (s)""",
}
SQL = as_integer(SQL, {"p6_ranked": "top_rank"})
