"""Resolution, validation, comparison and support queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators import link as L
from termloom.operators import resolve as RS
from termloom.operators import service as SV
from termloom.operators.packed import unpack
from termloom.plans.dictionary import _CODES, _ORDER, term_codes
from termloom.plans.search import _EXT, _NAMES, _named, neighbors_external
from termloom.plans.text import PACKED, _values_sql, key_sql, toks_sql
from termloom.session import as_integer, table


def resolve_text(spark: SparkSession, sf: str) -> DataFrame:
    docs, names = _named(spark, sf)
    why = table(spark, sf, "search_quality_patient_portal_queries", "row_id", "expected_cuis").where("expected_cuis is not null").select((-1 - F.col("row_id")).alias("doc"), F.col("expected_cuis").alias("text"))
    return RS.resolve_text(docs.unionByName(why), names, table(spark, sf, "labels", "cui").where("cui is not null"), term_codes(spark, sf), 8)


def mentions_maximal(spark: SparkSession, sf: str) -> DataFrame:
    docs, names = _named(spark, sf)
    return RS.maximal(L.candidates(docs, names, 8))


def mentions_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Best score of each concept as an answer to each piece of evidence."""
    docs, names = _named(spark, sf)
    n = table(spark, sf, "labels", "label", "cui", "ispref").select(T.normalized_key(F.col("label")).alias("key"), "cui", "ispref").where("key <> ''").groupBy("key").agg(F.countDistinct("cui").alias("cuis"), F.max((F.col("ispref") == "Y").cast("int")).alias("pref"))
    content = lambda c: F.size(F.filter(c, lambda t: ~t.isin(T.STOPWORDS)))
    spans = L.spans(docs, names, 8).join(n, "key")
    score = RS.span_score(F.col("n_tokens"), content(F.split("key", " ")), F.col("content"), F.col("cuis"), F.col("pref") == 1)
    return spans.groupBy("doc", "cui").agg(F.round(F.max(score), 6).alias("score"))


def labels_in_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that also stand among the texts of the vectors."""
    v = table(spark, sf, "vector_records", "text").select(T.normalized_key(F.col("text")).alias("key")).where("key <> ''").distinct()
    lab = table(spark, sf, "labels", "row_id", "label").select("row_id", T.normalized_key(F.col("label")).alias("key"))
    return lab.join(v, "key", "left_semi").select("row_id")


def label_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the dictionary that a curated supplement would refuse, by reason; one row may have several."""
    d = table(spark, sf, "labels", "row_id", "cui", "label", "sab")
    twice = d.where("label is not null").groupBy("cui", "label", "sab").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    j = d.join(twice, ["cui", "label", "sab"], "left")
    problems = F.array_compact(F.array(F.when(F.coalesce(F.trim("label"), F.lit("")) == "", "no_label"), F.when(~F.col("cui").rlike(r"^C\d{7}$"), "bad_id"), F.when((F.col("n") > 1) & (F.col("row_id") != F.col("first")), "repeated")))
    return j.select(F.explode(problems).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def lists_compared(spark: SparkSession, sf: str) -> DataFrame:
    """The two external neighbour lists of each concept: how many targets each has and they share, and how far the
    ranks of the shared ones lie apart."""
    n = neighbors_external(spark, sf).select("source", "source_cui", "target_cui", "place")
    a, b = (n.where(F.col("source") == s).select("source_cui", "target_cui", F.col("place").alias(p)) for s, p in (("ext_a", "pa"), ("ext_b", "pb")))
    both = a.join(b, ["source_cui", "target_cui"], "full_outer")
    return both.groupBy("source_cui").agg(F.count("pa").alias("n_a"), F.count("pb").alias("n_b"), F.count_if(F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("shared"), F.coalesce(F.sum(F.abs(F.col("pa") - F.col("pb"))), F.lit(0)).cast("long").alias("moved"))


def source_contribution(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, concepts and best weight of the evidence by source, by type and over both, in one pass."""
    e = table(spark, sf, "evidence", "source", "evidence_type", "cui", "weight").withColumn("source", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")))
    g = e.groupingSets([[F.col("source"), F.col("evidence_type")], [F.col("source")], []], F.col("source"), F.col("evidence_type"))
    return g.agg(F.count("*").alias("n"), F.countDistinct("cui").alias("concepts"), F.max("weight").alias("best"))


def literature_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations that trigger words in the evidence suggest between its concept and a kind of statement, with support
    of two texts or more."""
    e = table(spark, sf, "evidence", "cui", "text", "row_id").where("text is not null")
    rules = {"treatment": r"(?i)\b(?:was given for|treated|therapy)\b", "follow_up": r"(?i)\bfollow-up of\b", "case_series": r"(?i)\b\d+ cases\b", "duration": r"(?i)\bover \d+ days\b"}
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), n) for n, p in rules.items())))
    s = e.select("cui", F.explode(hit).alias("relation"), T.normalized_key(F.col("text")).alias("key"), "row_id")
    return s.groupBy("cui", "relation").agg(F.countDistinct("key").alias("support"), F.min("row_id").alias("first")).where("support >= 2")


def unit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts of the portal lists: how often expected and disallowed, and what follows for their evidence."""
    v = unpack(table(spark, sf, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED).withColumn("cui", F.upper(F.regexp_extract("val", r"^([A-Za-z]\d{7})", 1))).where("cui <> ''")
    c = v.groupBy("cui").agg(F.count_if(F.col("field") == "expected_cuis").alias("good"), F.count_if(F.col("field") == "disallowed_cuis").alias("bad"), F.count_if(F.col("field") == "context_cuis").alias("open"))
    d = F.when((F.col("bad") == 0) & (F.col("good") >= 2), "promote").when((F.col("good") == 0) & (F.col("bad") >= 2), "quarantine").when(F.col("bad") > F.col("good"), "demote").otherwise("neutral")
    return c.withColumn("decision", d)


def cross_source_support(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts with evidence from three kinds of source or more, scored by the sum over kinds of the best support."""
    e = table(spark, sf, "evidence", "cui", "source", "evidence_type", "evidence_id")
    per = e.groupBy("cui", "evidence_type", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source")).agg(F.countDistinct("evidence_id").alias("n")).groupBy("cui", "evidence_type").agg(F.max("n").alias("n"))
    c = per.groupBy("cui").agg(F.count("*").alias("kinds"), F.sum("n").alias("support")).where("kinds >= 3")
    return c.withColumn("score", F.round(F.col("kinds") + F.log10(1.0 + F.col("support")), 6))


def candidates_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of two lanes, relations and outside neighbours, as one row a concept pair with its lanes and best
    score; a pair of both lanes gets a bonus."""
    r = table(spark, sf, "relationship_edges", "source_cui", "target_cui", "strength").where("source_cui <> target_cui").groupBy("source_cui", "target_cui").agg(F.max(F.coalesce(F.nanvl("strength", F.lit(0.0)), F.lit(0.0))).alias("score")).withColumn("lane", F.lit("edges"))
    n = neighbors_external(spark, sf).groupBy("source_cui", "target_cui").agg(F.max("score").alias("score")).withColumn("lane", F.lit("vectors"))
    m = r.unionByName(n).groupBy("source_cui", "target_cui").agg(F.array_join(F.sort_array(F.collect_set("lane")), "+").alias("lanes"), F.max("score").alias("best"), F.count("*").alias("n"))
    return m.select("source_cui", "target_cui", "lanes", F.round(F.col("best") + 0.05 * (F.col("n") - 1), 6).alias("score"))


def label_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of distinct labels with all words stemmed, and how many labels fall together on each."""
    k = table(spark, sf, "labels", "label").select(T.tokens(F.col("label")).alias("t")).where("size(t) > 0").distinct()
    return k.select(F.array_join(F.transform("t", T.stem), " ").alias("variant"), F.array_join("t", " ").alias("key")).groupBy("variant").agg(F.countDistinct("key").alias("n_keys"), F.min("key").alias("first"))


def relation_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Uneven relation texts to canonical kinds."""
    r = F.lower(F.coalesce(F.nullif(F.col("rela"), F.lit("")), "relation"))
    kind = F.when(r.contains("treat"), "treats").when(r.contains("cause"), "causes").when(r.contains("isa") | r.isin("par", "chd"), "is_a").when(r.contains("part"), "part_of").when(r.contains("site"), "located_in").otherwise("associated_with")
    back = F.coalesce(r.startswith("inverse"), F.lit(False)) | (F.col("direction") == "incoming")
    return table(spark, sf, "related_concepts", "rela", "relation", "direction").groupBy(kind.alias("kind"), back.alias("backward")).agg(F.count("*").alias("n"))


def snippets_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of each concept by the share of its preferred label's words that it holds: the three best."""
    lab = table(spark, sf, "labels", "cui", "label").where("label is not null").groupBy("cui").agg(F.min("label").alias("label")).select("cui", F.array_distinct(T.tokens(F.col("label"))).alias("l")).where("size(l) > 0")
    e = table(spark, sf, "evidence", "row_id", "cui", "text").where("text is not null").join(lab, "cui")
    s = e.select("cui", "row_id", F.round(F.size(F.array_intersect("l", T.tokens(F.col("text")))) / F.size("l"), 6).alias("share"))
    place = F.row_number().over(Window.partitionBy("cui").orderBy(F.desc("share"), "row_id"))
    return s.withColumn("place", place).where("place <= 3")


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Each portal row by how much of its expected list stands in its context list and what disallowed does too."""
    v = unpack(table(spark, sf, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED).withColumn("cui", F.upper(F.regexp_extract("val", r"^([A-Za-z]+[:0-9]+)", 1)))
    g = v.groupBy("row_id").agg(*(F.collect_set(F.when(F.col("field") == f, F.col("cui"))).alias(f) for f in PACKED))
    hit = F.size(F.array_intersect("expected_cuis", "context_cuis")) / F.greatest(F.size("expected_cuis"), F.lit(1))
    bad = F.size(F.array_intersect("disallowed_cuis", "context_cuis"))
    verdict = F.when((hit >= 0.8) & (bad == 0), "good").when((hit > 0) | (bad == 0), "mixed").otherwise("poor")
    return g.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def label_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a usable norm get the smallest of their twins (same concept, source, type and label)."""
    d = table(spark, sf, "labels", "row_id", "cui", "sab", "tty", "label", "norm")
    twin = d.where("norm is not null and trim(norm) <> '' and label is not null").groupBy("cui", "sab", "tty", "label").agg(F.min("norm").alias("given"))
    return d.where("norm is null or trim(norm) = ''").join(twin, ["cui", "sab", "tty", "label"], "left").select("row_id", F.coalesce("given", T.normalized_key(F.col("label"))).alias("norm"))


def label_fit(spark: SparkSession, sf: str) -> DataFrame:
    """How many labels are fit for linking, and why not."""
    key = T.normalized_key(F.col("label"))
    n = F.size(F.split(key, " "))
    why = F.when(F.coalesce(key, F.lit("")) == "", "empty").when(~key.rlike("[a-z]"), "no_letter").when((n == 1) & (F.length(key) < 4), "short").when(n > 8, "long").otherwise("fit")
    return table(spark, sf, "labels", "label").groupBy(why.alias("verdict")).agg(F.count("*").alias("n"))


def search_page(spark: SparkSession, sf: str) -> DataFrame:
    """Top-k report: the first page of a word search among visible labels."""
    found = SV.answer(table(spark, sf, "labels"), SV.Request("rectum infarction"))
    return found.select("place", "row_id", "cui", "label")


def label_hash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return SV.hash_vectors(table(spark, sf, "labels", "row_id", "label"), "row_id", "label")


QUERIES = {
    f.__name__: f
    for f in (resolve_text, mentions_maximal, mentions_scored, labels_in_vectors, label_problems, lists_compared, source_contribution, literature_relations, unit_decisions, cross_source_support, candidates_merged, label_variants, relation_kinds, snippets_ranked, verdicts, label_backfill, label_fit, search_page, label_hash_vectors)
}

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_KEYS = f"keys as (select row_id as doc, {toks_sql('text')} as t, {key_sql('text')} as whole from evidence where text is not null), g as (select doc, t, whole, unnest(range(1, len(t) + 1)) as i from keys), h as (select doc, t, whole, i, unnest(range(1, 9)) as n from g), sp as (select doc, whole, i, n_tokens, key, cui from (select *, array_to_string(t[i:i + n - 1], ' ') as k from h where i + n - 1 <= len(t)) x join names on names.key = x.k)"
_V = f"v as (select row_id, field, upper(regexp_extract(val, '^([A-Za-z]+[:0-9]+)', 1)) as cui, val from ({_values_sql()}))"


def _stem_sql(x: str) -> str:
    und = lambda s: f"case when length({s}) >= 2 and right({s}, 1) = substr({s}, length({s}) - 1, 1) then left({s}, length({s}) - 1) else {s} end"
    return f"""case when {x} like '%ies' and length({x}) > 4 then left({x}, length({x}) - 3) || 'y' when {x} like '%ves' and length({x}) > 5 then left({x}, length({x}) - 3) || 'f' when {x} like '%ing' and length({x}) > 6 then {und(f'left({x}, length({x}) - 3)')}
when {x} like '%ed' and length({x}) > 5 then {und(f'left({x}, length({x}) - 2)')} when {x} like '%s' and length({x}) > 4 and not regexp_matches({x}, '(ss|us|is)$') and {x} not in ('diabetes', 'herpes', 'rabies', 'always', 'series') then left({x}, length({x}) - 1) else {x} end"""


SQL = {
    "resolve_text": f"""with {_NAMES}, {_KEYS}, d as (select row_id as doc, text from evidence where text is not null union all select -1 - row_id, expected_cuis from search_quality_patient_portal_queries where expected_cuis is not null),
k2 as (select doc, {toks_sql('text')} as t, {key_sql('text')} as whole from d where doc < 0), g2 as (select doc, t, whole, unnest(range(1, len(t) + 1)) as i from k2), h2 as (select doc, t, whole, i, unnest(range(1, 9)) as n from g2),
sp2 as (select doc, whole, n_tokens, key, cui from (select *, array_to_string(t[i:i + n - 1], ' ') as k from h2 where i + n - 1 <= len(t)) x join names on names.key = x.k),
{_CODES},
i as (select distinct doc, upper(unnest(regexp_extract_all(text, '\\b([Cc][0-9]{{7}})\\b', 1))) as target from d), sc as (select distinct doc, unnest(regexp_extract_all(text, '\\b([A-Z]{{2,8}}:[0-9]{{2,12}})\\b', 1)) as target from d),
bc as (select distinct doc, trim(unnest(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_:.-])', ' \\1 ', 'g'), '(?:^| )([0-9]{{4,12}})(?: |$)', 1))) as target from d), al as (select code, min(cui) as cui from co group by code having count(distinct cui) = 1),
u as (select doc, target, case when target in (select upper(cui) from labels where cui is not null) then 100 else 0 end as score, case when target in (select upper(cui) from labels where cui is not null) then 'identifier' else 'unknown' end as how from i
union all select doc, coalesce(cui, target), case when cui is null then 0 else 96 end, case when cui is null then 'unknown' else 'code' end from sc left join co on sc.target = co.system || ':' || co.code
union all select doc, cui, 88, 'bare code' from bc join al on bc.target = al.code
union all select doc, cui, 70 + 3 * n_tokens + case when key = whole then 15 else 0 end, 'name' from (select doc, whole, n_tokens, key, cui from sp union all select * from sp2))
select doc, target, cast(x.score as integer) as score, x.how from (select doc, target, max(struct_pack(score := score, how := how)) as x from u group by all)""",
    "mentions_maximal": f"with {_NAMES}, {_KEYS} select doc, cast(i as integer) as start, n_tokens, key, cui from sp a where not exists (select 1 from sp b where b.doc = a.doc and b.i <= a.i and b.i + b.n_tokens >= a.i + a.n_tokens and b.n_tokens > a.n_tokens)",
    "mentions_scored": f"""with {_NAMES}, {_KEYS}, n as (select {key_sql('label')} as key, count(distinct cui) as cuis, max(case when ispref = 'Y' then 1 else 0 end) as pref from labels group by 1),
q as (select doc, len(list_filter(t, lambda x: x not in ({_STOP}))) as q from keys), j as (select doc, sp.cui, n_tokens, cuis, pref, q, len(list_filter(string_split(sp.key, ' '), lambda x: x not in ({_STOP}))) as c from sp join n using (key) join q using (doc)),
s as (select doc, cui, case when cuis <= 3 then 0.15::double when cuis >= 20 then -0.15::double else 0.0::double end as rare, case when pref = 1 then 0.02::double else 0.0::double end as liked, n_tokens, c, q from j)
select doc, cui, round(max(case when c >= q then 1.05::double + 0.12::double * least(n_tokens, 5) + rare + liked when c = 1 then 0.68::double + 0.15::double * c / greatest(q, 1) + 0.30::double * rare + liked else 0.78::double + 0.35::double * c / greatest(q, 1) + 0.04::double * least(n_tokens, 4) + rare + liked end), 6) as score from s group by all""",
    "labels_in_vectors": f"select row_id from labels where {key_sql('label')} in (select {key_sql('text')} from vector_records where {key_sql('text')} <> '')",
    "label_problems": r"""with t as (select cui, label, sab, count(*) as n, min(row_id) as first from labels where label is not null group by all)
select problem, count(*) as n from (select 'no_label' as problem from labels where coalesce(trim(label, ' '), '') = '' union all select 'bad_id' from labels where not regexp_matches(cui, '^C\d{7}$') union all select 'repeated' from labels join t using (cui, label, sab) where n > 1 and row_id <> first) group by 1""",
    "lists_compared": f"""{_EXT}, a as (select * from n where source = 'ext_a'), b as (select * from n where source = 'ext_b')
select source_cui, count(a.place) as n_a, count(b.place) as n_b, count(*) filter (a.place is not null and b.place is not null) as shared, cast(coalesce(sum(abs(a.place - b.place)), 0) as bigint) as moved from a full join b using (source_cui, target_cui) group by source_cui""",
    "source_contribution": "select source, evidence_type, count(*) as n, count(distinct cui) as concepts, max(weight) as best from (select coalesce(lower(trim(source)), 'unknown') as source, evidence_type, cui, weight from evidence) group by grouping sets ((source, evidence_type), (source), ())",
    "literature_relations": f"""with s as (select cui, {key_sql('text')} as key, row_id, unnest(list_filter([case when regexp_matches(text, '(?i)\\b(?:was given for|treated|therapy)\\b') then 'treatment' end, case when regexp_matches(text, '(?i)\\bfollow-up of\\b') then 'follow_up' end,
case when regexp_matches(text, '(?i)\\b\\d+ cases\\b') then 'case_series' end, case when regexp_matches(text, '(?i)\\bover \\d+ days\\b') then 'duration' end], lambda x: x is not null)) as relation from evidence where text is not null)
select cui, relation, count(distinct key) as support, min(row_id) as first from s group by all having count(distinct key) >= 2""",
    "unit_decisions": f"""with v as (select field, upper(regexp_extract(val, '^([A-Za-z][0-9]{{7}})', 1)) as cui from ({_values_sql()})), c as (select cui, count(*) filter (field = 'expected_cuis') as good, count(*) filter (field = 'disallowed_cuis') as bad, count(*) filter (field = 'context_cuis') as open from v where cui <> '' group by 1)
select *, case when bad = 0 and good >= 2 then 'promote' when good = 0 and bad >= 2 then 'quarantine' when bad > good then 'demote' else 'neutral' end as decision from c""",
    "cross_source_support": """with p as (select cui, evidence_type, coalesce(lower(trim(source)), 'unknown') as s, count(distinct evidence_id) as n from evidence group by all), q as (select cui, evidence_type, max(n) as n from p group by all)
select cui, count(*) as kinds, cast(sum(n) as bigint) as support, round(count(*) + log10(1.0::double + sum(n)), 6) as score from q group by cui having count(*) >= 3""",
    "candidates_merged": f"""{_EXT}, r as (select source_cui, target_cui, max(coalesce(case when isnan(strength) then 0 else strength end, 0)) as score, 'edges' as lane from relationship_edges where source_cui <> target_cui group by all),
u as (select * from r union all select source_cui, target_cui, max(score), 'vectors' from n group by all)
select source_cui, target_cui, string_agg(distinct lane, '+' order by lane) as lanes, round(max(score) + 0.05::double * (count(*) - 1), 6) as score from u group by all""",
    "label_variants": f"""with k as (select distinct {toks_sql('label')} as t from labels), s as (select array_to_string(list_transform(t, lambda x: {_stem_sql('x')}), ' ') as variant, array_to_string(t, ' ') as key from k where len(t) > 0)
select variant, count(distinct key) as n_keys, min(key) as first from s group by 1""",
    "relation_kinds": """with r as (select lower(coalesce(nullif(rela, ''), relation)) as r, direction from related_concepts)
select case when r like '%treat%' then 'treats' when r like '%cause%' then 'causes' when r like '%isa%' or r in ('par', 'chd') then 'is_a' when r like '%part%' then 'part_of' when r like '%site%' then 'located_in' else 'associated_with' end as kind, coalesce(starts_with(r, 'inverse'), false) or direction = 'incoming' as backward, count(*) as n from r group by all""",
    "snippets_ranked": f"""with l as (select cui, list_distinct({toks_sql('label')}) as l from (select cui, min(label) as label from labels where label is not null group by 1)), s as (select e.cui, row_id, round(len(list_intersect(l, {toks_sql('text')})) / len(l), 6) as share from evidence e join l using (cui) where text is not null and len(l) > 0)
select cui, row_id, share, row_number() over (partition by cui order by share desc, row_id) as place from s qualify place <= 3""",
    "verdicts": f"""with {_V}, g as (select row_id, coalesce(list(distinct cui) filter (field = 'expected_cuis'), []) as e, coalesce(list(distinct cui) filter (field = 'disallowed_cuis'), []) as d, coalesce(list(distinct cui) filter (field = 'context_cuis'), []) as c from v group by 1),
h as (select len(list_intersect(e, c)) / greatest(len(e), 1) as hit, len(list_intersect(d, c)) as bad from g)
select case when hit >= 0.8 and bad = 0 then 'good' when hit > 0 or bad = 0 then 'mixed' else 'poor' end as verdict, count(*) as n from h group by 1""",
    "label_backfill": f"""with t as (select cui, sab, tty, label, min(norm) as given from labels where norm is not null and trim(norm, ' ') <> '' and label is not null group by all)
select row_id, coalesce(given, {key_sql('l.label')}) as norm from labels l left join t on l.cui = t.cui and l.sab = t.sab and l.tty = t.tty and l.label = t.label where norm is null or trim(norm, ' ') = ''""",
    "search_page": f"""with b as (select cui, row_id, label from labels where label is not null and suppress = 'N' and list_contains({toks_sql('label')}, 'rectum') and list_contains({toks_sql('label')}, 'infarction') qualify row_number() over (partition by cui order by {_ORDER}) = 1)
select row_number() over (order by case when lower(label) = 'rectum infarction' then 0 else 1 end, length(label), label, row_id) as place, row_id, cui, label from b qualify place <= 25""",
    "label_fit": f"""with k as (select {key_sql('label')} as k from labels) select case when coalesce(k, '') = '' then 'empty' when not regexp_matches(k, '[a-z]') then 'no_letter' when len(string_split(k, ' ')) = 1 and length(k) < 4 then 'short' when len(string_split(k, ' ')) > 8 then 'long' else 'fit' end as verdict, count(*) as n from k group by 1""",
}
SQL = as_integer(SQL, {"resolve_text": "score", "mentions_maximal": "n_tokens", "snippets_ranked": "place", "search_page": "place"})
