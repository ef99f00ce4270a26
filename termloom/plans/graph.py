"""Graph, incremental and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.operators import evaluation as V
from termloom.operators import graph as G
from termloom.operators import incremental as I
from termloom.operators.packed import unpack
from termloom.plans.text import PACKED, _values_sql
from termloom.session import as_integer, table

_REL = ["row_id", "source_cui", "target_cui", "relation", "rela", "direction"]


def edges_topk(spark: SparkSession, sf: str) -> DataFrame:
    return G.best_edges(table(spark, sf, "related_concepts", *_REL), 16)


def edges_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    return G.both_ways(table(spark, sf, "related_concepts", *_REL))


def edges_two_hops(spark: SparkSession, sf: str) -> DataFrame:
    return G.two_hops(table(spark, sf, "related_concepts", *_REL), 5)


def edges_views(spark: SparkSession, sf: str) -> DataFrame:
    return G.grouped_view(table(spark, sf, "relationship_edges", "row_id", "source_cui", "target_cui", "relation_group", "strength"), "relation_group", 6)


def edges_score(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_score(table(spark, sf, "relationship_edges", "source_cui", "strength", "confidence"), 0.055, 0.22).withColumn("score", F.round("score", 6))


def edges_strength(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "relationship_edges", "row_id", "source_class", "context_json", "rank")
    support = F.regexp_extract(F.coalesce("context_json", F.lit("")), r"(\d+) trial", 1)
    return e.select("row_id", F.round(G.edge_strength(F.col("source_class"), F.when(support != "", support.cast("int")), F.col("rank")), 6).alias("strength"))


def edges_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "relationship_edges", "row_id", "source_cui", "target_cui", "relationship_type", "source_class", "edge_json")
    once = e.groupBy("source_cui", "target_cui", "relationship_type", "source_class", "edge_json").agg(F.min("row_id").alias("row_id"))
    return once.groupBy("source_class").agg(F.count("*").alias("n_edges"))


def edges_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """The nested edge as columns, with the row's own values where the edge has none."""
    e = table(spark, sf, "relationship_edges", "row_id", "source_cui", "target_cui", "relationship_type", "confidence", "edge_json")
    j = F.from_json("edge_json", "subject string, object string, type string, strength double, confidence double")
    return e.withColumn("j", j).select("row_id", F.coalesce("j.subject", "source_cui").alias("subject"), F.coalesce("j.object", "target_cui").alias("object"), F.coalesce("j.type", "relationship_type").alias("type"), F.coalesce("confidence", "j.confidence").alias("confidence"))


def edges_reverse(spark: SparkSession, sf: str) -> DataFrame:
    """Incoming links of each concept: how many, from how many concepts, by relation."""
    e = table(spark, sf, "related_concepts", "source_cui", "target_cui", "relation")
    return e.groupBy(F.col("target_cui").alias("cui"), F.upper("relation").alias("relation")).agg(F.count("*").alias("n"), F.countDistinct("source_cui").alias("n_sources"))


def edges_cross_category(spark: SparkSession, sf: str) -> DataFrame:
    """Links between concepts whose evidence is mostly of different views, by pair of views."""
    view = table(spark, sf, "evidence", "cui", "view").groupBy("cui", "view").agg(F.count("*").alias("n")).groupBy("cui").agg(F.max_by("view", F.struct("n", "view")).alias("view"))
    e = table(spark, sf, "relationship_edges", "source_cui", "target_cui")
    a = e.join(view.select(F.col("cui").alias("source_cui"), F.col("view").alias("source_view")), "source_cui").join(view.select(F.col("cui").alias("target_cui"), F.col("view").alias("target_view")), "target_cui")
    return a.where("source_view <> target_view").groupBy("source_view", "target_view").agg(F.count("*").alias("n"))


def pair_utility(spark: SparkSession, sf: str) -> DataFrame:
    """Unordered concept pairs by how often and how strongly they are linked; the hundred most useful."""
    e = table(spark, sf, "relationship_edges", "source_cui", "target_cui", "strength", "source_class").where("source_cui <> target_cui")
    s = F.coalesce(F.nanvl("strength", F.lit(0.0)), F.lit(0.0))
    p = e.groupBy(F.least("source_cui", "target_cui").alias("a"), F.greatest("source_cui", "target_cui").alias("b")).agg(F.count("*").alias("n"), F.max(s).alias("best"), F.countDistinct("source_class").alias("classes"))
    u = p.withColumn("utility", F.round(F.log1p("n") * (1 + F.col("best")) * (1 + 0.25 * (F.col("classes") - 1)), 6))
    return u.orderBy(F.desc("utility"), "a", "b").limit(100).select("a", "b", "n", "utility")


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "labels", "row_id", "cui", "label", "sab", "tty", "suppress")
    half = (rows.agg(F.max("row_id")).first()[0] or 0) / 2
    return rows.where(F.col("row_id") < half), rows.where(F.col("row_id") >= half)


_ATOM = ["label", "sab", "tty", "suppress"]


def release_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return I.fingerprints(table(spark, sf, "labels", "cui", *_ATOM), "cui", _ATOM)


def release_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _halves(spark, sf)
    return I.diff(I.fingerprints(old, "cui", _ATOM), I.fingerprints(new, "cui", _ATOM), "cui")


def vector_reuse(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vector_records", "row_id", "doc_id", "text", "vector").where("doc_id is not null")
    hashed = v.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    half = (v.agg(F.max("row_id")).first()[0] or 0) / 2
    last = lambda d: d.groupBy("doc_id").agg(F.max_by("text_hash", "row_id").alias("text_hash"))
    old = hashed.where(F.col("row_id") < half)
    return I.reuse_plan(last(hashed), last(old), old.withColumn("order", F.col("row_id")), 64)


def vector_assembly(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vector_records", "row_id", "doc_id", "vector").where("doc_id is not null")
    half = (v.agg(F.max("row_id")).first()[0] or 0) / 2
    return I.assembly_problems(v.where(F.col("row_id") < half), v, 64)


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Hits and expected ids: the context list of each portal row taken as a ranking against its expected list."""
    v = unpack(table(spark, sf, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED)
    v = v.withColumn("cui", F.upper(F.regexp_extract("val", r"^([A-Za-z]+[:0-9]+)", 1))).withColumn("query", F.col("row_id"))
    hits = v.where("field <> 'expected_cuis'").select("query", "cui", (F.col("pos") + F.when(F.col("field") == "context_cuis", 0).otherwise(3)).alias("rank"))
    return hits, v.where("field = 'expected_cuis'").select("query", "cui")


def metrics_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = V.row_metrics(*_judged(spark, sf))
    return r.withColumn("recall", F.round("recall", 6)).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "search_quality_patient_portal_queries").select(F.col("row_id").alias("query"), "expected_behavior", F.year("received_at").alias("year"))
    return V.summary(V.row_metrics(*_judged(spark, sf)).join(meta, "query"), ["expected_behavior", "year"])


def metrics_gates(spark: SparkSession, sf: str) -> DataFrame:
    """The later half of the rows gated against the earlier half."""
    r = V.row_metrics(*_judged(spark, sf))
    half = (table(spark, sf, "search_quality_patient_portal_queries", "row_id").agg(F.max("row_id")).first()[0] or 0) / 2
    long = lambda d: d.agg(*(F.avg(c).alias(c) for c in ("found_at_1", "found_at_10", "recall", "reciprocal_rank"))).unpivot([], ["found_at_1", "found_at_10", "recall", "reciprocal_rank"], "metric", "value")
    g = V.gates(long(r.where(F.col("query") >= half)), long(r.where(F.col("query") < half)), 0.02)
    return g.select("metric", F.round("current", 6).alias("current"), F.round("baseline", 6).alias("baseline"), "passed")


def metrics_disallowed(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of each row that are both expected or context and disallowed."""
    v = unpack(table(spark, sf, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED)
    v = v.withColumn("cui", F.upper(F.regexp_extract("val", r"^([A-Za-z]+[:0-9]+)", 1)))
    bad = v.where("field = 'disallowed_cuis'").select("row_id", "cui").distinct()
    return v.where("field <> 'disallowed_cuis'").select("row_id", "cui").distinct().join(bad, ["row_id", "cui"])


def stage_progression(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean event value by type; a day is rejected when it lies below the day before."""
    d = table(spark, sf, "events", "ts", "event_type", "value").groupBy(F.col("event_type").alias("group"), F.to_date("ts").cast("string").alias("stage")).agg(F.round(F.avg("value"), 6).alias("value"))
    before = F.lag("value").over(Window.partitionBy("group").orderBy("stage"))
    return V.progression(d.withColumn("rejected", F.coalesce(F.col("value") < before, F.lit(False))))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events", "event_type", "value").groupBy("event_type").agg(*(F.round(F.percentile("value", p), 6).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.99)))


def coverage_share(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence by semantic view: concepts, rows, share, and whether a view is thin."""
    g = table(spark, sf, "evidence", "view", "cui").groupBy("view").agg(F.countDistinct("cui").alias("concepts"), F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    return g.withColumn("share", F.round(share, 6)).withColumn("thin", share < 0.1)


def query_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sampling operator: a fixed pseudorandom hundred of the search terms, the same on every run."""
    q = table(spark, sf, "query_rows", "row_id", "search_term").withColumn("h", F.md5(F.concat(F.lit("7/"), F.col("row_id").cast("string"))))
    return q.orderBy("h").limit(100).select("row_id", "search_term")


QUERIES = {
    f.__name__: f
    for f in (edges_topk, edges_both_ways, edges_two_hops, edges_views, edges_score, edges_strength, edges_dedupe, edges_flatten, edges_reverse, edges_cross_category, pair_utility, release_fingerprints, release_diff, vector_reuse, vector_assembly, metrics_rows, metrics_summary, metrics_gates, metrics_disallowed, stage_progression, latency_percentiles, coverage_share, query_sample)
}

_PLACE = "case " + " ".join(f"when upper(relation) = '{r}' then {i}" for i, r in enumerate(G.RELATION_ORDER, 1)) + " else 50 end"
_PAIR = f"select *, coalesce(rela, '') as r from related_concepts where source_cui <> target_cui qualify row_number() over (partition by source_cui, target_cui order by {_PLACE}, coalesce(rela, ''), direction, row_id) = 1"


def _best(n: int) -> str:
    return f"select source_cui, row_number() over (partition by source_cui order by {_PLACE}, r, target_cui) as place, target_cui, r as rela, direction, row_id from ({_PAIR}) qualify place <= {n}"


_NAME = "case when coalesce(rela, '') <> '' then rela else coalesce(relation, '') end"
_INV = f"case lower({_NAME}) " + " ".join(f"when '{a}' then '{b}'" for a, b in G.INVERSE.items()) + f" else case when {_NAME} = '' then 'inverse_related_to' else 'inverse_' || {_NAME} end end"
_KNOWN = "coalesce(case when isnan({c}) then 0 else {c} end, 0)"
_HALF = "(select max(row_id) / 2.0 from labels)"


def _prints(where: str) -> str:
    cols = " || chr(9) || ".join(f"coalesce({c}, '')" for c in _ATOM)
    return f"select cui, count(*) as n_atoms, sha256(string_agg(d, chr(10) order by d)) as fingerprint from (select distinct cui, sha256({cols}) as d from labels where {where}) group by cui"


_JUDGED = f"""v as (select row_id, field, pos, upper(regexp_extract(val, '^([A-Za-z]+[:0-9]+)', 1)) as cui from ({_values_sql()})),
h as (select row_id, cui, min(pos + case when field = 'context_cuis' then 0 else 3 end) as rank from v where field <> 'expected_cuis' group by all),
r as (select e.row_id as query, count(*) as n_expected, count(h.rank) as n_found, max(case when h.rank <= 1 then 1 else 0 end) as found_at_1, max(case when h.rank <= 3 then 1 else 0 end) as found_at_3,
max(case when h.rank <= 5 then 1 else 0 end) as found_at_5, max(case when h.rank <= 10 then 1 else 0 end) as found_at_10, count(h.rank) / count(*) as recall, coalesce(1.0::double / min(h.rank), 0) as reciprocal_rank
from (select distinct row_id, cui from v where field = 'expected_cuis') e left join h using (row_id, cui) group by e.row_id)"""
_MEANS = ", ".join(f"round(avg({c}), 6) as {n}" for c, n in [(f"found_at_{k}", f"found_at_{k}") for k in (1, 3, 5, 10)] + [("recall", "recall"), ("reciprocal_rank", "mrr")])
_VHALF = "(select max(row_id) / 2.0 from vector_records where doc_id is not null)"

SQL = {
    "edges_topk": _best(16),
    "edges_both_ways": f"select row_id, source_cui, target_cui, {_NAME} as name, 'outgoing' as way from related_concepts where source_cui <> target_cui union all select row_id, target_cui, source_cui, {_INV}, 'incoming' from related_concepts where source_cui <> target_cui",
    "edges_two_hops": f"with b as ({_best(5)}) select x.source_cui as a, y.target_cui as c, count(*) as ways, min(x.target_cui) as first_via from b x join b y on x.target_cui = y.source_cui where x.source_cui <> y.target_cui group by all",
    "edges_views": f"""with o as (select source_cui, relation_group, target_cui, {_KNOWN.format(c='strength')} as s, row_id from relationship_edges qualify row_number() over (partition by source_cui, relation_group, target_cui order by s desc, row_id) = 1)
select source_cui, relation_group, row_number() over (partition by source_cui, relation_group order by s desc, target_cui) as place, target_cui, s as strength from o qualify place <= 6""",
    "edges_score": f"select source_cui, count(*) as n_edges, round(least(0.22::double, sum(least(0.055::double, {_KNOWN.format(c='strength')} * {_KNOWN.format(c='confidence')}))), 6) as score from relationship_edges group by 1",
    "edges_strength": r"""select row_id, round(greatest(0.0::double, least(1.0::double, case source_class when 'curated_seed' then 0.80::double when 'review' then 0.70::double when 'ohdsi' then 0.60::double else 0.45::double end
+ 0.02::double * least(coalesce(try_cast(nullif(regexp_extract(coalesce(context_json, ''), '(\d+) trial', 1), '') as integer), 0), 10) - 0.002::double * least(coalesce(rank, 50), 50))), 6) as strength from relationship_edges""",
    "edges_dedupe": "select source_class, count(*) as n_edges from (select distinct source_cui, target_cui, relationship_type, source_class, edge_json from relationship_edges) group by 1",
    "edges_flatten": "select row_id, coalesce(edge_json ->> '$.subject', source_cui) as subject, coalesce(edge_json ->> '$.object', target_cui) as object, coalesce(edge_json ->> '$.type', relationship_type) as type, coalesce(confidence, cast(edge_json ->> '$.confidence' as double)) as confidence from relationship_edges",
    "edges_reverse": "select target_cui as cui, upper(relation) as relation, count(*) as n, count(distinct source_cui) as n_sources from related_concepts group by all",
    "edges_cross_category": """with c as (select cui, view, count(*) as n from evidence group by all), d as (select cui, view from c qualify row_number() over (partition by cui order by n desc, view desc) = 1)
select a.view as source_view, b.view as target_view, count(*) as n from relationship_edges e join d a on a.cui = e.source_cui join d b on b.cui = e.target_cui where a.view <> b.view group by all""",
    "pair_utility": f"""with p as (select least(source_cui, target_cui) as a, greatest(source_cui, target_cui) as b, count(*) as n, max({_KNOWN.format(c='strength')}) as best, count(distinct source_class) as classes from relationship_edges where source_cui <> target_cui group by all)
select a, b, n, round(ln(1 + n) * (1 + best) * (1 + 0.25::double * (classes - 1)), 6) as utility from p order by utility desc, a, b limit 100""",
    "release_fingerprints": _prints("true"),
    "release_diff": f"""with o as ({_prints(f'row_id < {_HALF}')}), n as ({_prints(f'row_id >= {_HALF}')})
select coalesce(o.cui, n.cui) as cui, case when o.cui is null then 'added' when n.cui is null then 'removed' else 'changed' end as change from o full join n on o.cui = n.cui where o.cui is null or n.cui is null or o.fingerprint <> n.fingerprint""",
    "vector_reuse": f"""with h as (select row_id, doc_id, sha256(coalesce(text, '')) as t, vector from vector_records where doc_id is not null), n as (select doc_id, arg_max(t, row_id) as t from h group by 1),
o as (select doc_id, t, vector from h where row_id < {_VHALF} qualify row_number() over (partition by doc_id order by row_id desc) = 1),
j as (select n.doc_id, case when o.doc_id is null then 'new_document' when o.t <> n.t then 'text_changed' when coalesce(len(o.vector), -1) <> 64 then 'wrong_length' else 'unchanged' end as reason from n left join o using (doc_id))
select doc_id, case when reason = 'unchanged' then 'reuse' else 'embed' end as action, reason from j""",
    "vector_assembly": f"""with m as (select distinct doc_id from vector_records where doc_id is not null and row_id < {_VHALF}), c as (select doc_id, count(*) as n, max(case when coalesce(len(vector), -1) <> 64 then 1 else 0 end) as bad from vector_records where doc_id is not null group by 1)
select doc_id, 'extra' as problem from c where doc_id not in (select doc_id from m) union all select doc_id, 'duplicate' from c where n > 1 union all select doc_id, 'length' from c where bad = 1 union all select doc_id, 'missing' from m where doc_id not in (select doc_id from c)""",
    "metrics_rows": f"with {_JUDGED} select * replace (round(recall, 6) as recall, round(reciprocal_rank, 6) as reciprocal_rank) from r",
    "metrics_summary": f"""with {_JUDGED}, j as (select r.*, coalesce(q.expected_behavior, '') as b, coalesce(cast(year(q.received_at) as varchar), '') as y from r join search_quality_patient_portal_queries q on q.row_id = r.query)
select 'all' as grain, '' as value, count(*) as n, {_MEANS} from j union all select 'expected_behavior', b, count(*), {_MEANS} from j group by b union all select 'year', y, count(*), {_MEANS} from j group by y""",
    "metrics_gates": f"""with {_JUDGED}, s as (select query >= (select max(row_id) / 2.0 from search_quality_patient_portal_queries) as late, * from r), u as (unpivot (select late, avg(found_at_1) as found_at_1, avg(found_at_10) as found_at_10, avg(recall) as recall, avg(reciprocal_rank) as reciprocal_rank from s group by late) on found_at_1, found_at_10, recall, reciprocal_rank into name metric value value)
select c.metric, round(c.value, 6) as current, round(b.value, 6) as baseline, c.value >= b.value - 0.02::double as passed from u c join u b on c.metric = b.metric where c.late and not b.late""",
    "metrics_disallowed": f"with v as (select distinct row_id, field = 'disallowed_cuis' as bad, upper(regexp_extract(val, '^([A-Za-z]+[:0-9]+)', 1)) as cui from ({_values_sql()})) select a.row_id, a.cui from v a join v b using (row_id, cui) where not a.bad and b.bad",
    "stage_progression": """with d as (select event_type as "group", strftime(ts, '%Y-%m-%d') as stage, round(avg(value), 6) as value from events group by all), r as (select *, coalesce(value < lag(value) over (partition by "group" order by stage), false) as rejected from d),
k as (select *, first_value(value) over (partition by "group" order by stage) as f, last_value(case when not rejected then value end ignore nulls) over (partition by "group" order by stage rows between unbounded preceding and 1 preceding) as k from r)
select "group", stage, round(value - f, 6) as since_first, round(value - coalesce(k, f), 6) as since_kept from k""",
    "latency_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1",
    "coverage_share": "select view, count(distinct cui) as concepts, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share, count(*) / sum(count(*)) over () < 0.1 as thin from evidence group by 1",
    "query_sample": "select row_id, search_term from query_rows order by md5('7/' || row_id) limit 100",
}
SQL = as_integer(SQL, {"edges_topk": "place", "edges_views": "place"})
