"""The united search, hits of long documents, related concepts in buckets, and evaluation in full, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import graph as G
from termloom.operators import judging as J
from termloom.operators import link as L
from termloom.operators import related as RL
from termloom.operators import unified as U
from termloom.operators.packed import unpack
from termloom.plans.graph import _PAIR, _PLACE
from termloom.plans.search import _EXT, _GENERIC, _NAMES, _STOPS, neighbors_external
from termloom.plans.text import PACKED, _values_sql, key_sql, toks_sql
from termloom.session import as_integer, cut, table


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return L.dictionary(table(spark, sf, "labels", "label", "cui"), 8, 2)


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """All search terms, and the context lists of the portal rows as queries by identifier (negative numbers)."""
    terms = table(spark, sf, "query_rows", "row_id", "search_term").select(F.col("row_id").alias("query"), F.col("search_term").alias("text"))
    lists = table(spark, sf, "search_quality_patient_portal_queries", "row_id", "context_cuis").select((-1 - F.col("row_id")).alias("query"), F.col("context_cuis").alias("text"))
    return terms.unionByName(lists).where("text is not null")


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    near = neighbors_external(spark, sf).groupBy("source_cui", F.col("target_cui").alias("cui")).agg(F.max("score").alias("weight"))
    graph = G.best_edges(table(spark, sf, "related_concepts"), 3).select("source_cui", F.col("target_cui").alias("cui"), (1.0 / F.col("place")).alias("weight"))
    return near, graph


def _texts(q: DataFrame) -> DataFrame:
    """(query, n, text): each text once, with the lowest of its queries and their number."""
    return cut(q.groupBy("text").agg(F.min("query").alias("query"), F.count("*").alias("n")))


def _united(spark: SparkSession, sf: str, q: DataFrame) -> DataFrame:
    label = cut(U.label_lane(q, cut(_names(spark, sf)), 8))
    definitions = table(spark, sf, "obo_terms", "definition", "xrefs").where("definition is not null").select(F.explode("xrefs").alias("x"), F.col("definition").alias("text")).select(F.upper(F.regexp_extract("x", r"\b([Cc][0-9]{7})\b", 1)).alias("cui"), "text").where("cui <> ''")
    near, graph = _links(spark, sf)
    code = U.code_lane(q, table(spark, sf, "labels", "cui"))
    lanes = {"label": label, "code": code, "definition": U.definition_lane(q, definitions), "vector": U.spread_lane(label, near), "graph": U.spread_lane(label.unionByName(code), graph)}
    return U.unite(lanes)


def search_united(spark: SparkSession, sf: str) -> DataFrame:
    """Top-k report: the first page of ten of every query over all lanes."""
    q = _queries(spark, sf)
    texts = _texts(q)
    hits = U.hydrate(cut(U.page(_united(spark, sf, texts), 10)), table(spark, sf, "labels", "cui", "label"), table(spark, sf, "evidence", "cui"))
    same = q.join(texts.select("text", F.col("query").alias("first")), "text").select("query", "first")
    hits = hits.withColumnRenamed("query", "first").join(same, "first")
    return hits.select("query", "place", "cui", "label", "lanes", "rank_score", "evidence_count", "level")


def search_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates by the lanes they come from."""
    texts = _texts(_queries(spark, sf))
    hits = _united(spark, sf, texts).join(texts.select("query", F.col("n").alias("times")), "query")
    return hits.groupBy("lanes").agg(F.sum("times").alias("n"), F.round(F.sum(F.col("rank_score") * F.col("times")), 3).alias("total"))


def search_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """Every label as a query over the definitions."""
    q = table(spark, sf, "labels", "row_id", "label").select(F.col("row_id").alias("query"), F.col("label").alias("text"))
    d = table(spark, sf, "obo_terms", "term_id", "definition").where("definition is not null and term_id is not null").select(F.col("term_id").alias("cui"), F.col("definition").alias("text"))
    return U.definition_lane(q, d).select("query", F.col("cui").alias("term_id"), F.round("score", 6).alias("score"))


def doc_concept_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Search terms named in the chunks of long documents, united by document; a term is its own concept."""
    c = table(spark, sf, "long_document_chunks", "row_id", "doc_id", "chunk_index", "section", "text").where("text is not null")
    terms = table(spark, sf, "query_rows", "search_term").select(F.col("search_term").alias("label"), T.normalized_key(F.col("search_term")).alias("cui"))
    names = L.dictionary(terms, 8, 1)
    spans = L.candidates(c.select(F.col("row_id").alias("doc"), "text"), names, 8).groupBy(F.col("doc").alias("row_id"), "cui").agg(F.max(0.5 + 0.05 * F.col("n_tokens")).alias("score"))
    hits = spans.join(c.select("row_id", F.col("doc_id").alias("doc"), F.col("chunk_index").alias("chunk"), F.coalesce(T.normalized_key(F.col("section")), F.lit("")).alias("section")), "row_id")
    return U.document_hits(hits).withColumn("score", F.round("score", 6))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "relationship_edges", "row_id", "source_cui", "target_cui", "relationship_type", "relation_group", "source_class", "strength", "confidence")


def related_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Related concepts strong and sure enough, each in the first bucket it fits, six a bucket."""
    return RL.buckets(_edges(spark, sf), 0.58, 0.50, 6)


def related_union(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of two sources, curated edges before release relations: a target once, five a concept."""
    first = _edges(spark, sf).where("source_class = 'curated_seed'").select("source_cui", "target_cui", "row_id")
    second = table(spark, sf, "related_concepts", "source_cui", "target_cui", "row_id")
    return RL.first_wins([first, second], 5)


def related_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of each concept: label, names, evidence, relations each way and the strongest target."""
    return RL.bundle(table(spark, sf, "labels", "cui", "label"), table(spark, sf, "evidence", "cui"), _edges(spark, sf))


def related_roles(spark: SparkSession, sf: str) -> DataFrame:
    """What concepts two links away are to each other, by the kinds of the two links."""
    return RL.roles(_edges(spark, sf).where("source_class in ('curated_seed', 'review')"))


def edge_structs(spark: SparkSession, sf: str) -> DataFrame:
    """Each relation with its canonical edge."""
    e = table(spark, sf, "related_concepts", "row_id", "source_cui", "target_cui", "relation", "rela", "direction")
    return RL.canonical(e).select("row_id", "edge.subject", "edge.object", "edge.kind", "edge.useful")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    v = unpack(table(spark, sf, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED)
    return v.withColumn("cui", F.upper(F.regexp_extract("val", r"^([A-Za-z]+[:0-9]+)", 1))).where("cui <> ''")


def _ranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = _packed(spark, sf).withColumnRenamed("row_id", "query")
    hits = v.where("field = 'context_cuis'").select("query", "cui", F.col("pos").alias("rank"))
    return hits, v.where("field = 'expected_cuis'").select("query", "cui"), v.where("field = 'disallowed_cuis'").select("query", "cui")


def quality_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of each row's expected concepts, or concepts of the same name, at several depths, and its verdict."""
    hits, expected, bad = _ranked(spark, sf)
    keys = table(spark, sf, "labels", "cui", "label").select(T.normalized_key(F.col("label")).alias("key"), "cui").where("key <> '' and cui is not null").distinct()
    narrow = keys.groupBy("key").agg(F.count("*").alias("n")).where("n between 2 and 5").select("key")
    same = keys.join(narrow, "key")
    other = same.join(same.select("key", F.col("cui").alias("other")), "key").where("cui <> other").select("cui", "other").distinct()
    return J.coverage(hits, expected, bad, other)


def quality_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """What each source of evidence brings to the expected and to the disallowed hits."""
    hits, expected, bad = _ranked(spark, sf)
    source = table(spark, sf, "evidence", "cui", "source").select("cui", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source")).distinct()
    return J.by_source(hits, expected, bad, source)


def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The later half of the evidence against the earlier half: counts by source must not collapse, and the share of
    weighted rows and the number of sources must keep their bounds."""
    e = table(spark, sf, "evidence", "row_id", "source", "weight").withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")))
    half = (e.agg(F.max("row_id")).first()[0] or 0) / 2
    tell = lambda d: d.groupBy("source").agg(F.count("*").alias("n"))
    now, before = e.where(F.col("row_id") >= half), e.where(F.col("row_id") < half)
    collapse = J.collapsed(tell(now), tell(before), 0.5)
    values = now.agg(F.round(F.avg(F.col("weight").isNotNull().cast("int")), 6).alias("weighted"), F.countDistinct("source").cast("double").alias("sources"))
    return collapse.unionByName(J.bounds(values, {"weighted": (0.5, None), "sources": (3.0, 100.0)}))


def quality_units(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on concepts learned on one part of the rows and told apart from how they fare on the rest."""
    v = _packed(spark, sf).withColumn("part", F.when(F.substring(F.md5(F.col("row_id").cast("string")), 1, 1) < "b", "dev").otherwise("held_out"))
    judged = v.select("cui", "part", F.when(F.col("field") == "expected_cuis", 1).when(F.col("field") == "disallowed_cuis", -1).otherwise(0).alias("grade"))
    return J.unit_decisions(judged)


def judgments_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with the judgment of the source that comes last: expected, then disallowed, by list."""
    hits, expected, bad = _ranked(spark, sf)
    sources = expected.withColumn("grade", F.lit(1)).withColumn("order", F.lit(1)).unionByName(bad.withColumn("grade", F.lit(-1)).withColumn("order", F.lit(2)))
    return J.joined(hits, sources)


def retrieval_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Outside neighbour lists as retrieved documents, against relations as judgments: what is not judged is unknown."""
    n = neighbors_external(spark, sf).select(F.concat_ws(":", "source", "source_cui").alias("topic"), "source_cui", F.col("target_cui").alias("doc"), F.col("place").alias("rank"))
    e = _edges(spark, sf).where("strength is not null and not isnan(strength)").groupBy("source_cui", F.col("target_cui").alias("doc")).agg(F.max((F.col("strength") >= 0.5).cast("int")).alias("grade"))
    return J.retrieval(n.drop("source_cui"), n.select("topic", "source_cui").distinct().join(e, "source_cui").select("topic", "doc", "grade"), (3, 5))


QUERIES = {
    f.__name__: f
    for f in (search_united, search_lanes, search_definitions, doc_concept_hits, related_buckets, related_union, related_bundle, related_roles, edge_structs, quality_coverage, quality_by_source, quality_gates, quality_units, judgments_joined, retrieval_documents)
}

_Q = f"q as (select row_id as query, search_term as text from query_rows where search_term is not null union all select -1 - row_id, context_cuis from search_quality_patient_portal_queries where context_cuis is not null)"
_SPANS = lambda src: f"t as (select query, text, {toks_sql('text')} as t from {src}), g as (select query, t, unnest(range(1, len(t) + 1)) as i from t), h as (select query, t, i, unnest(range(1, 9)) as n from g), sp as (select query, len(t) as size, n_tokens, cui from (select query, t, array_to_string(t[i:i + n - 1], ' ') as k from h where i + n - 1 <= len(t)) x join names on names.key = x.k)"
_DEF = lambda src, key: f"""u as (select query, list_filter(list_distinct({toks_sql('text')}), lambda x: length(x) >= 3 and x not in ({_STOPS})) as t from {src}), du as (select distinct {key}, list_distinct({toks_sql('definition')}) as w from dd),
dl as (select query, {key}, max(len(t)::double / len(w)) as score from u join du on len(t) between 2 and 8 and len(w) > 0 and len(list_filter(t, lambda x: len(list_filter(w, lambda y: starts_with(y, x))) > 0)) = len(t) group by all)"""  # noqa: E731
_UNITED = f"""{_EXT.removeprefix("with ")}, {_NAMES}, {_Q}, {_SPANS('q')}, dd as (select upper(regexp_extract(unnest(xrefs), '\\b([Cc][0-9]{{7}})\\b', 1)) as cui, definition from obo_terms where definition is not null),
{_DEF('q', 'cui')}, lab as (select query, cui, max(0.5::double + 0.5::double * n_tokens / size) as score from sp group by all),
cod as (select distinct query, cui, 1.0::double as score from (select query, upper(unnest(regexp_extract_all(text, '\\b([Cc][0-9]{{7}})\\b', 1))) as cui from q) where cui in (select cui from labels where cui is not null)),
vec as (select query, target_cui as cui, max(l.score * n.score) as score from lab l join (select source_cui, target_cui, max(score) as score from n group by all) n on n.source_cui = l.cui group by all),
be as (select source_cui, target_cui, row_number() over (partition by source_cui order by {_PLACE}, r, target_cui, direction, row_id) as place from ({_PAIR}) qualify place <= 3),
gra as (select query, target_cui as cui, max(score / place) as score from (select * from lab union all select * from cod) l join be on be.source_cui = l.cui group by all),
al as (select query, cui, 'label' as lane, score from lab union all select query, cui, 'code', score from cod union all select query, cui, 'definition', score from dl where cui <> '' union all select query, cui, 'vector', score from vec union all select query, cui, 'graph', score from gra),
hits as (select query, cui, array_to_string(list_sort(list_distinct(list(lane))), '+') as lanes, round(coalesce(max(score) filter (lane = 'label'), 0) * 1.0::double + coalesce(max(score) filter (lane = 'code'), 0) * 1.0::double + coalesce(max(score) filter (lane = 'definition'), 0) * 0.5::double + coalesce(max(score) filter (lane = 'vector'), 0) * 0.3::double + coalesce(max(score) filter (lane = 'graph'), 0) * 0.2::double, 6) as rank_score from al group by all)"""
_V = f"v as (select * from (select row_id as query, field, pos, upper(regexp_extract(val, '^([A-Za-z]+[:0-9]+)', 1)) as cui from ({_values_sql()})) where cui <> ''), hit as (select query, cui, min(pos) as rank from v where field = 'context_cuis' group by all), ex as (select distinct query, cui from v where field = 'expected_cuis'), bad as (select distinct query, cui from v where field = 'disallowed_cuis')"
_SRC = "coalesce(lower(trim(source)), 'unknown')"

SQL = {
    "search_united": f"""with {_UNITED}, p as (select *, row_number() over (partition by query order by rank_score desc, cui) as place from hits qualify place <= 10)
select query, place, p.cui, label, lanes, rank_score, coalesce(evidence_count, 0) as evidence_count, case when rank_score >= 0.9 and coalesce(evidence_count, 0) > 0 then 'high' when rank_score >= 0.6 then 'medium' else 'low' end as level
from p left join (select cui, min(label) as label from labels where label is not null group by 1) l using (cui) left join (select cui, count(*) as evidence_count from evidence group by 1) e using (cui) where rank_score >= 0.35 or place = 1""",
    "search_lanes": f"with {_UNITED} select lanes, count(*) as n, round(sum(rank_score), 3) as total from hits group by 1",
    "search_definitions": f"with q as (select row_id as query, label as text from labels), dd as (select term_id, definition from obo_terms where definition is not null and term_id is not null), {_DEF('q', 'term_id')} select query, term_id, round(score, 6) as score from dl",
    "doc_concept_hits": f"""with {_NAMES.replace(f"select {key_sql('label')} as key, cui from labels", f"select {key_sql('search_term')} as key, {key_sql('search_term')} as cui from query_rows")}, q as (select row_id as query, text from long_document_chunks where text is not null), {_SPANS('q')}, s as (select query, cui, max(0.5::double + 0.05::double * n_tokens) as score from sp group by all),
c as (select row_id as query, doc_id as doc, chunk_index as chunk, coalesce({key_sql('section')}, '') as section from long_document_chunks)
select doc, cui, round(max(score), 6) as score, min(chunk) as first_chunk, count(distinct chunk) as n_chunks, array_to_string(list_sort(list_distinct(list(section))), ',') as sections from s join c using (query) group by all""",
    **RL.SQL,
    "quality_coverage": f"""with {_V}, keys as (select distinct {key_sql('label')} as key, cui from labels where cui is not null), k2 as (select * from keys where key <> ''), nar as (select key from k2 group by key having count(*) between 2 and 5),
oth as (select distinct a.cui, b.cui as other from k2 a join k2 b using (key) where a.cui <> b.cui and key in (select key from nar)),
own as (select ex.query, ex.cui, hit.rank from ex left join hit using (query, cui)), alt as (select ex.query, ex.cui, min(hit.rank) as rank from ex join oth on oth.cui = ex.cui join hit on hit.query = ex.query and hit.cui = oth.other group by all),
best as (select own.query, own.cui, least(own.rank, alt.rank) as rank from own left join alt using (query, cui)), b10 as (select hit.query, count(*) as n from hit join bad using (query, cui) where rank <= 10 group by 1),
c as (select query, {", ".join(f"round(count(*) filter (rank <= {k})::double / count(*), 6) as coverage_{k}" for k in (5, 10, 20, 60))} from best group by 1)
select c.*, coalesce(n, 0) as disallowed_10, case when coverage_10 >= 0.8 and coalesce(n, 0) = 0 then 'good' when coverage_20 > 0 then 'mixed' else 'poor' end as verdict from c left join b10 using (query)""",
    "quality_by_source": f"""with {_V}, s as (select distinct cui, {_SRC} as source from evidence)
select source, count(*) as hits, count(ex.cui) as expected_hits, count(bad.cui) as bad_hits, min(rank) as best_rank from hit join s using (cui) left join ex using (query, cui) left join bad using (query, cui) group by 1""",
    "quality_gates": f"""with e as (select {_SRC} as source, weight, row_id >= (select max(row_id) from evidence) / 2 as late from evidence), c as (select source, count(*) filter (late) as now, count(*) filter (not late) as before from e group by 1),
v as (select round(avg(case when weight is not null then 1 else 0 end), 6) as weighted, cast(count(distinct source) as double) as sources from e where late)
select 'source_collapse:' || source as gate, cast(now as double) as value, now >= 0.5 * before as passed from c union all select 'weighted', weighted, weighted >= 0.5 from v union all select 'sources', sources, sources between 3 and 100 from v""",
    "quality_units": f"""with {_V}, j as (select cui, case when left(md5(cast(query as varchar)), 1) < 'b' then 'dev' else 'held_out' end as part, case field when 'expected_cuis' then 1 when 'disallowed_cuis' then -1 else 0 end as grade from v),
c as (select cui, {", ".join(f"count(*) filter (part = '{p}' and grade = {g}) as {p}_{n}" for p in ("dev", "held_out") for n, g in (("good", 1), ("bad", -1), ("open", 0)))} from j group by 1)
select *, case when dev_bad = 0 and dev_good >= 2 and held_out_bad = 0 then 'promote' when dev_good = 0 and dev_bad >= 2 then 'quarantine' when dev_bad > dev_good then 'demote' else 'neutral' end as decision from c""",
    "judgments_joined": f"with {_V} select hit.query, hit.cui, rank, case when bad.cui is not null then -1 when ex.cui is not null then 1 end as grade from hit left join ex using (query, cui) left join bad using (query, cui)",
    "retrieval_documents": f"""{_EXT}, r as (select source || ':' || source_cui as topic, source_cui, target_cui as doc, place as rank from n), e as (select source_cui, target_cui as doc, max(case when strength >= 0.5 then 1 else 0 end) as grade from relationship_edges where strength is not null and not isnan(strength) group by all),
jd as (select distinct topic, e.doc, grade from (select distinct topic, source_cui from r) join e using (source_cui)), tot as (select topic, count(*) filter (grade > 0) as relevant from jd group by 1),
x as (select r.topic, r.doc, rank, grade from r left join jd on jd.topic = r.topic and jd.doc = r.doc)
select topic, count(*) as retrieved, count(grade) as judged, {", ".join(f"round(count(*) filter (rank <= {k} and grade > 0)::double / {k}, 6) as precision_{k}, round(count(*) filter (rank <= {k} and grade is not null)::double / {k}, 6) as judged_{k}" for k in (3, 5))},
round(coalesce(1.0::double / min(rank) filter (grade > 0), 0), 6) as reciprocal_rank, round(case when any_value(relevant) > 0 then count(*) filter (grade > 0)::double / any_value(relevant) end, 6) as recall from x left join tot using (topic) group by topic""",
}
SQL = as_integer(SQL, {"search_united": "place"})
