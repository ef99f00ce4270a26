"""Search, linking, re-ranking, streaming and star-schema queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import link as L
from termloom.operators import rerank as R
from termloom.operators import search as S
from termloom.plans.text import key_sql, toks_sql
from termloom.session import as_integer, table
from termloom.streaming import events as EV


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vector")
    sane = F.coalesce((F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return table(spark, sf, "vector_records", "row_id", "cui", "vector").where(sane & F.col("cui").isNotNull()).select("row_id", "cui", v.alias("v"))


def knn_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every record whose id is divisible by 100 against all records: its ten nearest concepts."""
    v = _vectors(spark, sf)
    found = S.knn(v.where("row_id % 100 = 0").select(F.col("row_id").alias("query"), "v"), v, 10)
    return found.select("query", "cui", "rank", F.round("score", 6).alias("score"))


def knn_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The same over the plain embeddings, by label."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    v = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("cui"), F.col("embedding").alias("v"))
    found = S.knn(v.where("row_id % 100 = 0").select(F.col("row_id").alias("query"), "v"), v, 5)
    return found.select("query", F.col("cui").alias("label"), "rank", F.round("score", 6).alias("score"))


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).select("row_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("norm"))


def neighbors_external(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour lists delivered from outside, cleaned: best score of each pair, five per source and concept."""
    n = table(spark, sf, "external_cui_neighbors", "source", "source_cui", "target_cui", "score").where("score is not null and not isnan(score) and source_cui <> target_cui")
    once = n.groupBy("source", "source_cui", "target_cui").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("source", "source_cui").orderBy(F.desc("score"), "target_cui"))
    return once.withColumn("place", place).where("place <= 5")


def bm25_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items as queries over the evidence texts: the ten best of each."""
    docs = table(spark, sf, "evidence", "row_id", "text").where("text is not null").select(F.col("row_id").alias("doc"), T.tokens(F.col("text")).alias("terms"))
    queries = table(spark, sf, "eval_items", "item_id", "text").select(F.col("item_id").alias("query"), T.tokens(F.col("text")).alias("terms"))
    found = S.bm25(docs, queries).withColumn("score", F.round("score", 6))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return found.withColumn("place", place).where("place <= 10")


def _named(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    names = L.dictionary(table(spark, sf, "labels", "label", "cui"), 8, 2)
    return table(spark, sf, "evidence", "row_id", "text").where("text is not null").select(F.col("row_id").alias("doc"), "text"), names


def link_candidates(spark: SparkSession, sf: str) -> DataFrame:
    docs, names = _named(spark, sf)
    return L.candidates(docs, names, 8)


def link_evidence(spark: SparkSession, sf: str) -> DataFrame:
    docs, names = _named(spark, sf)
    return L.link(docs, names, 8, 7)


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits for the external neighbour lists: each source's concept a query, its neighbours the hits."""
    n = neighbors_external(spark, sf)
    lab = table(spark, sf, "labels", "cui", "label").where("label is not null").groupBy("cui").agg(F.min("label").alias("label"))
    ev = table(spark, sf, "evidence", "cui").groupBy("cui").agg(F.count("*").alias("evidence_count"))
    j = n.join(lab.select(F.col("cui").alias("source_cui"), F.col("label").alias("q")), "source_cui").join(lab.select(F.col("cui").alias("target_cui"), F.col("label").alias("l")), "target_cui").join(ev.select(F.col("cui").alias("target_cui"), "evidence_count"), "target_cui", "left")
    q, t = T.tokens(F.col("q")), T.tokens(F.col("l"))
    return j.select(F.concat_ws(":", "source", "source_cui").alias("query"), F.col("target_cui").alias("cui"), F.col("score").alias("vector_score"), T.label_relevance(q, t).alias("relevance"), (T.normalized_key(F.col("q")) == T.normalized_key(F.col("l"))).alias("exact"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), (F.size(F.array_distinct(t)) > 2).alias("qualified"), t.alias("tokens"), F.array_intersect(q, t).alias("covered"))


def rerank_score(spark: SparkSession, sf: str) -> DataFrame:
    r = R.score(_hits(spark, sf))
    return r.select("query", "cui", *(F.round(f"add_{n}", 6).alias(n) for n in R.addends()), F.round("rank_score", 6).alias("rank_score"))


def rerank_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return R.cutoff(R.score(_hits(spark, sf)), [F.col("vector_score") >= 0.9, F.col("relevance") > 0, F.col("evidence_count") >= 5]).select("query", "cui")


def rerank_specificity(spark: SparkSession, sf: str) -> DataFrame:
    """The names of each concept as hits for it: how many others hold all words of a name and more."""
    named = table(spark, sf, "labels", "cui", "label").where("cui is not null").select(F.col("cui").alias("query"), T.normalized_key(F.col("label")).alias("cui")).where("cui <> ''").distinct()
    return R.less_specific(named.withColumn("tokens", F.split("cui", " ")), 0.1).select("query", F.col("cui").alias("name"), "rivals")


def rerank_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return R.score(_hits(spark, sf)).withColumn("c", R.confidence(F.col("rank_score"), F.col("exact"), F.col("evidence_count"))).select("query", "cui", "c.score", "c.level")


def rerank_diverse(spark: SparkSession, sf: str) -> DataFrame:
    return R.diverse(R.score(_hits(spark, sf)), 3)


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return EV.tumbling(table(spark, sf, "events"))


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return EV.sliding(table(spark, sf, "events"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return EV.sessions(table(spark, sf, "events"))


def stream_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return EV.first_seen(table(spark, sf, "events")).groupBy("event_type").agg(F.count("*").alias("n"))


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(disc), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("count_order"))


def top_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Top-k report: the twenty customers with the highest revenue, with nation and region."""
    rev = table(spark, sf, "orders", "o_orderkey", "o_custkey").join(table(spark, sf, "lineitem", "l_orderkey", "l_extendedprice", "l_discount"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey").join(rev, F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.orderBy(F.desc("revenue"), "c_custkey").limit(20).select("c_custkey", "c_name", "n_name", "r_name", "revenue")


QUERIES = {
    f.__name__: f
    for f in (knn_search, knn_embeddings, vector_norms, neighbors_external, bm25_evidence, link_candidates, link_evidence, rerank_score, rerank_cutoff, rerank_specificity, rerank_confidence, rerank_diverse, stream_tumbling, stream_sliding, stream_sessions, stream_first_seen, pricing_summary, top_customers)
}

_SANE = "len(vector) = 64 and len(list_filter(vector, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0"
_EXT = "with o as (select source, source_cui, target_cui, max(score) as score from external_cui_neighbors where score is not null and not isnan(score) and source_cui <> target_cui group by all), n as (select *, row_number() over (partition by source, source_cui order by score desc, target_cui) as place from o qualify place <= 5)"
_HITS = f"""{_EXT}, lab as (select cui, min(label) as label from labels where label is not null group by 1), ev as (select cui, count(*) as evidence_count from evidence group by 1),
h0 as (select n.source || ':' || n.source_cui as query, n.target_cui as cui, n.score as vector_score, {toks_sql('a.label')} as q, list_filter({toks_sql('b.label')}, lambda x, i: list_position({toks_sql('b.label')}, x) = i) as l,
{key_sql('a.label')} = {key_sql('b.label')} as exact, coalesce(evidence_count, 0) as evidence_count from n join lab a on a.cui = n.source_cui join lab b on b.cui = n.target_cui left join ev on ev.cui = n.target_cui),
h1 as (select *, len(list_filter(l, lambda x: list_contains(q, x))) as m, cast(list_reduce(q, lambda i, t: case when l[cast(i as bigint) + 1] = t then cast(cast(i as bigint) + 1 as varchar) else i end, '0') as bigint) as taken from h0),
h as (select *, len(l) > 2 as qualified, case when len(l) = 0 or m = 0 then 0.0::double when m = len(l) then 0.60::double + 0.10::double * least(len(l), 5) + case when taken = len(l) then 0.08::double else 0 end
+ case when contains(' ' || array_to_string(q, ' ') || ' ', ' ' || array_to_string(l, ' ') || ' ') then 0.05::double else 0 end else 0.25::double + 0.35::double * m / len(l) + 0.03::double * least(m, 4) end as relevance from h1),
s as (select *, 0.12::double * greatest(0, least(1, (vector_score - 0.72::double) / 0.18::double)) as a_vector, case when relevance > 0 then 0.03::double + 0.04::double * greatest(0, least(1, (relevance - 0.90::double) / 0.45::double)) else 0 end as a_label,
case when exact then 0.18::double else 0 end as a_exact, case when evidence_count > 0 then 0.04::double else -0.10::double end as a_evidence, case when qualified then 0.0::double else -0.25::double end as a_unqualified from h),
t as (select *, a_vector + a_label + a_exact + a_evidence + a_unqualified as rank_score from s)"""
_STOPS = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_GENERIC = ", ".join(f"'{w}'" for w in L.GENERIC)
_NAMES = f"""names as (select key, min(cui) as cui, len(string_split(key, ' ')) as n_tokens from (select {key_sql('label')} as key, cui from labels) where regexp_matches(key, '[a-z]') group by key
having count(distinct cui) <= 2 and n_tokens <= 8 and string_split(key, ' ')[1] not in ({_STOPS}) and string_split(key, ' ')[-1] not in ({_STOPS}) and (n_tokens > 1 or length(key) >= 4 and key not in ({_GENERIC})))"""

SQL = {
    "knn_search": f"""with v as (select row_id, cui, cast(vector as double[]) as v from vector_records where {_SANE} and cui is not null), b as (select a.row_id as query, b.cui, max(list_cosine_similarity(a.v, b.v)) as score from v a join v b on a.row_id <> b.row_id where a.row_id % 100 = 0 group by all)
select query, cui, row_number() over (partition by query order by score desc, cui) as rank, round(score, 6) as score from b qualify rank <= 10""",
    "knn_embeddings": """with v as (select vec_id, cast(label as varchar) as label, cast(embedding as double[]) as v from embeddings), b as (select a.vec_id as query, b.label, max(list_cosine_similarity(a.v, b.v)) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 group by all)
select query, label, row_number() over (partition by query order by score desc, label) as rank, round(score, 6) as score from b qualify rank <= 5""",
    "vector_norms": f"select row_id, round(sqrt(list_sum(list_transform(vector, lambda x: cast(x as double) * cast(x as double)))), 4) as norm from vector_records where {_SANE} and cui is not null",
    "neighbors_external": f"{_EXT} select * from n",
    "bm25_evidence": f"""with d as (select row_id as doc, {toks_sql('text')} as t from evidence where text is not null), st as (select count(*) as n, avg(len(t)) as mean from d),
q as (select item_id as query, unnest(list_distinct({toks_sql('text')})) as term from eval_items), p as (select doc, len(t) as len, unnest(t) as term from d), tf as (select doc, len, term, count(*) as tf from p group by all), df as (select term, count(*) as df from tf group by 1),
b as (select query, doc, round(sum(ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean))), 6) as score from tf join df using (term) join q using (term), st group by all)
select query, doc, score, row_number() over (partition by query order by score desc, doc) as place from b qualify place <= 10""",
    "link_candidates": f"""with {_NAMES}, t as (select row_id as doc, {toks_sql('text')} as t from evidence where text is not null), g as (select doc, t, unnest(range(1, len(t) + 1)) as i from t), h as (select doc, t, i, unnest(range(1, 9)) as n from g)
select doc, cast(i as integer) as start, n_tokens, key, cui from (select doc, i, array_to_string(t[i:i + n - 1], ' ') as k from h where i + n - 1 <= len(t)) x join names on names.key = x.k""",
    "rerank_score": f"{_HITS} select query, cui, round(a_vector, 6) as vector, round(a_label, 6) as label, round(a_exact, 6) as exact, round(a_evidence, 6) as evidence, round(a_unqualified, 6) as unqualified, round(rank_score, 6) as rank_score from t",
    "rerank_cutoff": f"""{_HITS}, c1 as (select * from t qualify vector_score >= 0.9 or count(*) filter (vector_score >= 0.9) over (partition by query) = 0), c2 as (select * from c1 qualify relevance > 0 or count(*) filter (relevance > 0) over (partition by query) = 0)
select query, cui from (select * from c2 qualify evidence_count >= 5 or count(*) filter (evidence_count >= 5) over (partition by query) = 0)""",
    "rerank_specificity": f"""with k as (select distinct cui as query, {key_sql('label')} as name from labels where cui is not null), l as (select *, list_distinct(string_split(name, ' ')) as l from k where name <> '')
select a.query, a.name, count(*) as rivals from l a join l b on a.query = b.query and a.name <> b.name and len(b.l) > len(a.l) and len(list_intersect(a.l, b.l)) = len(a.l) group by all""",
    "rerank_confidence": f"""{_HITS}, c as (select query, cui, greatest(0, least(1, 0.20::double + 0.42::double * greatest(0, least(1, (rank_score - 0.05::double) / 0.35::double)) + case when exact then 0.14::double else 0 end + case when evidence_count > 0 then 0.12::double else 0 end)) as v from t)
select query, cui, round(v, 6) as score, case when v >= 0.7 then 'high' when v >= 0.45 then 'medium' else 'low' end as level from c""",
    "stream_tumbling": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "stream_sliding": "select start, count(*) as n from (select unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as start from events) group by 1",
    "stream_sessions": """with o as (select user_id, ts, case when ts < lag(ts) over w + interval '30 minutes' then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from o)
select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*) as n from s group by user_id, s""",
    "stream_first_seen": "select event_type, count(distinct event_id) as n from events group by 1",
    "pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_quantity), 4) as avg_qty, count(*) as count_order from lineitem where l_shipdate <= timestamp '1998-09-02' group by all",
    "top_customers": """select c_custkey, c_name, n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
group by all order by revenue desc, c_custkey limit 20""",
}
SQL = as_integer(SQL, {"knn_search": "rank", "knn_embeddings": "rank", "neighbors_external": "place", "bm25_evidence": "place", "link_candidates": "n_tokens"})
