"""Lexical features, inference from words, unions, guards and small joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import lexical as X
from termloom.functions import text as T
from termloom.plans.more import _stem_sql
from termloom.plans.text import PACKED, _values_sql, hash_embedding, key_sql, toks_sql
from termloom.operators.packed import unpack
from termloom.session import as_integer, table

ALLOWED = ["pubmed", "query_log"]


def text_token_spans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels", "row_id", "label").where("label is not null").select("row_id", F.posexplode(X.token_spans(F.col("label"))).alias("p", "s")).select("row_id", (F.col("p") + 1).alias("place"), "s.token", "s.start", F.col("s.end").alias("end"))


def text_variant_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels", "row_id", "label").select("row_id", F.explode(X.variant_keys(T.tokens(F.col("label")))).alias("key"))


def text_content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "query_rows", "row_id", "search_term").select("row_id", F.array_join(X.content_tokens(F.col("search_term")), " ").alias("content"), F.array_join(X.specific_tokens(F.col("search_term")), " ").alias("specific"))


def query_expansions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "query_rows", "row_id", "search_term").select("row_id", X.expanded(F.col("search_term")).alias("expanded")).where("expanded is not null")


def mention_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence of each chunk that a search cue stands in."""
    c = table(spark, sf, "long_document_chunks", "row_id", "text").where("text is not null")
    return c.select("row_id", X.sentence_with(F.col("text"), "protocol").alias("context")).where("context is not null")


def denial_penalties(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents", "doc_id", "text").where("text is not null")
    return X.denied(d.select(F.col("doc_id").alias("doc"), "text")).withColumnRenamed("doc", "doc_id")


def label_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes that the words of a label give away, an edge each."""
    return table(spark, sf, "labels", "row_id", "label").select("row_id", F.explode(X.attributes(F.col("label"))).alias("a")).select("row_id", "a.attribute", "a.value")


def new_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of the search terms that no label has, counted once a term and not behind a denial, with the kind their
    last word suggests and what follows for them."""
    grams = table(spark, sf, "query_rows", "row_id", "search_term").select("row_id", T.tokens(F.col("search_term")).alias("t")).withColumn("g", F.explode(T.ngrams(F.col("t"), 3)))
    before = F.when(F.col("g.start") > 1, F.element_at("t", F.col("g.start") - 1))
    words = F.split("g.text", " ")
    fit = (F.col("g.length") >= 2) & ~F.element_at(words, 1).isin(T.STOPWORDS) & ~F.element_at(words, -1).isin(T.STOPWORDS) & ~F.coalesce(before.isin(X.DENIALS), F.lit(False)) & ~F.col("g.text").rlike("[0-9]")
    known = table(spark, sf, "labels", "label").select(T.normalized_key(F.col("label")).alias("phrase")).where("phrase <> ''").distinct()
    n = grams.where(fit).select("row_id", F.col("g.text").alias("phrase")).distinct().groupBy("phrase").agg(F.count("*").alias("support")).where("support >= 3").join(known, "phrase", "left_anti")
    last = F.element_at(F.split("phrase", " "), -1)
    return n.select("phrase", "support", X.kind_of_word(last).alias("kind"), F.when(F.col("support") >= 20, "propose").when(F.col("support") >= 8, "review").otherwise("watch").alias("decision"))


def association_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Expected and context concepts of one portal row as associations: nearest places, rows, prior from how much
    evidence the target has."""
    v = _cuis(spark, sf)
    a, b = (v.where(F.col("field") == f).select("row_id", F.col("cui").alias(c), F.col("pos").alias(p)) for f, c, p in (("expected_cuis", "subject", "p"), ("context_cuis", "object", "q")))
    pairs = a.join(b, "row_id").where("subject <> object").groupBy("subject", "object").agg(F.countDistinct("row_id").alias("n_rows"), F.min(F.abs(F.col("p") - F.col("q"))).alias("nearest"))
    prior = table(spark, sf, "evidence", "cui").groupBy(F.col("cui").alias("object")).agg(F.count("*").alias("e"))
    score = F.col("n_rows") / (1.0 + F.col("nearest")) + 0.1 * F.log10(1.0 + F.coalesce("e", F.lit(0)))
    kind = F.when(F.col("nearest") == 0, "same place").when(F.col("n_rows") >= 2, "recurrent").otherwise("single")
    return pairs.join(prior, "object", "left").select("subject", "object", "n_rows", "nearest", kind.alias("kind"), F.round(score, 6).alias("score"))


def _cuis(spark: SparkSession, sf: str) -> DataFrame:
    v = unpack(table(spark, sf, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED)
    return v.withColumn("cui", F.upper(F.regexp_extract("val", r"^([A-Za-z]+[:0-9]+)", 1))).where("cui <> ''")


def concept_set_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Concept sets of the portal rows (context without disallowed, widened by the targets of part-of and is-a relations)
    against the expected concepts of the row: an edge each, with a confidence from its number of rows."""
    v = _cuis(spark, sf)
    bad = v.where("field = 'disallowed_cuis'").select("row_id", "cui").distinct()
    items = v.where("field = 'context_cuis'").select("row_id", "cui").distinct().join(bad, ["row_id", "cui"], "left_anti")
    wider = table(spark, sf, "related_concepts", "source_cui", "target_cui", "rela").where("rela in ('isa', 'part_of') and source_cui <> target_cui").select(F.col("source_cui").alias("cui"), "target_cui").distinct()
    every = items.unionByName(items.join(wider, "cui").select("row_id", F.col("target_cui").alias("cui"))).distinct()
    want = v.where("field = 'expected_cuis'").select("row_id", F.col("cui").alias("object")).distinct()
    e = every.join(want, "row_id").where("cui <> object").groupBy(F.col("cui").alias("subject"), "object").agg(F.count("*").alias("n"))
    return e.withColumn("confidence", F.round(1.0 - 1.0 / (1.0 + F.col("n")), 6))


def cross_namespace_terms(spark: SparkSession, sf: str) -> DataFrame:
    """From term over outside concept, relation and outside concept to a term of another namespace: of each term and
    other namespace the best by strength and id."""
    t = table(spark, sf, "obo_terms", "term_id", "namespace", "xrefs").where("term_id is not null and namespace is not null").select("term_id", "namespace", F.explode("xrefs").alias("cui")).where("cui is not null").distinct()
    e = table(spark, sf, "relationship_edges", "source_cui", "target_cui", "strength").groupBy("source_cui", "target_cui").agg(F.max(F.coalesce(F.nanvl("strength", F.lit(0.0)), F.lit(0.0))).alias("s"))
    b = t.select(F.col("cui").alias("target_cui"), F.col("term_id").alias("other_id"), F.col("namespace").alias("other_namespace"))
    j = t.withColumnRenamed("cui", "source_cui").join(e, "source_cui").join(b, "target_cui").where("namespace <> other_namespace")
    best = j.groupBy("term_id", "namespace", "other_namespace").agg(F.min(F.struct((-F.col("s")).alias("s"), "other_id")).alias("o"))
    return best.select("term_id", "namespace", "other_namespace", "o.other_id", (-F.col("o.s") + 0.0).alias("strength"))


def edges_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Edges both of whose ends a term of the hierarchy stands for, each by its best term."""
    best = table(spark, sf, "obo_terms", "term_id", "xrefs").where("term_id is not null").select("term_id", F.explode("xrefs").alias("cui")).where("cui is not null").groupBy("cui").agg(F.min("term_id").alias("term_id"))
    side = lambda c, t: best.select(F.col("cui").alias(c), F.col("term_id").alias(t))
    e = table(spark, sf, "relationship_edges", "row_id", "source_cui", "target_cui")
    return e.join(side("source_cui", "subject_term"), "source_cui").join(side("target_cui", "object_term"), "target_cui").select("row_id", "subject_term", "object_term")


def term_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of each term row, its own first, spellings that differ in case only once, order kept."""
    names = F.filter(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    return table(spark, sf, "obo_terms", "row_id", "name", "synonyms").select("row_id", F.array_join(X.union_of(names), "|").alias("names"))


def evidence_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Per concept and view the heaviest row of each text, the first to arrive where weights are equal; three a view."""
    e = table(spark, sf, "evidence", "row_id", "cui", "view", "text", "weight").where("text is not null").select("cui", "view", T.normalized_key(F.col("text")).alias("norm"), F.struct((-F.coalesce("weight", F.lit(1.0))).alias("w"), "row_id").alias("o"))
    once = e.groupBy("cui", "view", "norm").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("cui", "view").orderBy("o"))
    return once.withColumn("place", place).where("place <= 3").select("cui", "view", "place", "o.row_id")


def definitions_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence texts as definitions: each once a concept, by the source's place in the order of trust, length and
    text; two a concept."""
    e = table(spark, sf, "evidence", "cui", "text", "source").where("text is not null")
    trust = F.coalesce(F.array_position(F.array(*map(F.lit, X.TRUSTED)), F.lower(F.trim("source"))), F.lit(0))
    order = F.struct(F.when(trust == 0, 99).otherwise(trust).alias("p"), F.length("text").alias("n"), F.lower("text").alias("t"), F.col("text").alias("text"))
    once = e.groupBy("cui", T.normalized_key(F.col("text")).alias("key")).agg(F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("cui").orderBy("o"))
    return once.withColumn("place", place).where("place <= 2").select("cui", "place", "o.text")


def display_names(spark: SparkSession, sf: str) -> DataFrame:
    """The name to show for each concept: that of its term where there is one, else its smallest label."""
    override = table(spark, sf, "obo_terms", "name", "xrefs").where("name is not null").select("name", F.explode("xrefs").alias("cui")).where("cui is not null").groupBy("cui").agg(F.min("name").alias("override"))
    own = table(spark, sf, "labels", "cui", "label").where("cui is not null and label is not null").groupBy("cui").agg(F.min("label").alias("label"))
    return own.join(override, "cui", "left").select("cui", F.coalesce("override", "label").alias("display"), F.col("override").isNotNull().alias("overridden"))


def guarded_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the query log that may leave as aggregates and those that may not, by reason."""
    return X.guarded(table(spark, sf, "query_rows", "unique_users", "search_term"), "unique_users", "search_term", 5).groupBy("verdict").agg(F.count("*").alias("n"))


def public_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts all of whose evidence comes from sources that may be shown, with the number of sources."""
    e = table(spark, sf, "evidence", "cui", "source").groupBy("cui").agg(F.min(F.coalesce(F.lower(F.trim("source")).isin(ALLOWED), F.lit(False)).cast("int")).alias("ok"), F.countDistinct(F.lower(F.trim("source"))).alias("n_sources"))
    return e.where("ok = 1").select("cui", "n_sources")


def documents_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Hash vectors of the labels as records: numbers that are not zero, their sum, and the hash of the text."""
    v = hash_embedding(spark, sf).groupBy("row_id").agg(F.count("*").alias("n_numbers"), F.round(F.sum("value"), 4).alias("total"))
    t = table(spark, sf, "labels", "row_id", "label").select("row_id", F.sha2("label", 256).alias("text_hash"))
    return v.join(t, "row_id")


def query_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Sampling operator: the fifty queries of run 3 among those that runs 1 and 2 did not take."""
    q = table(spark, sf, "query_rows", "row_id", "search_term").where("search_term is not null")
    seen = None
    for run in (1, 2, 3):
        left = q if seen is None else q.join(seen, "row_id", "left_anti")
        taken = left.orderBy(F.md5(F.concat(F.lit(f"{run}/"), F.col("row_id").cast("string")))).limit(50)
        seen = taken.select("row_id") if seen is None else seen.unionByName(taken.select("row_id"))
    return taken.select("row_id", "search_term")


QUERIES = {
    f.__name__: f
    for f in (text_token_spans, text_variant_keys, text_content_tokens, query_expansions, mention_contexts, denial_penalties, label_attributes, new_concepts, association_pairs, concept_set_edges, cross_namespace_terms, edges_resolved, term_names, evidence_first_seen, definitions_by_source, display_names, guarded_counts, public_concepts, documents_embedded, query_rotation)
}

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_C = f"v as (select * from (select row_id, field, pos, upper(regexp_extract(val, '^([A-Za-z]+[:0-9]+)', 1)) as cui from ({_values_sql()})) where cui <> '')"
_alias = lambda x: f"coalesce(map {{{', '.join(f"'{a}': '{b}'" for a, b in X.ALIASES.items())}}}[{x}], {x})"
_content = f"list_filter(list_transform(list_filter({toks_sql('search_term')}, lambda x: x not in ({_STOP})), lambda x: {_alias('(' + _stem_sql(_alias('x')) + ')')}), lambda x: x <> '')"
_DENY = ", ".join(f"'{w}'" for w in X.DENIALS)
_case = lambda x, d, e: "case " + " ".join(f"when {x} in ({', '.join(f"'{w}'" for w in ws)}) then '{k}'" for k, ws in d.items()) + f" else '{e}' end"

SQL = {
    "text_token_spans": r"""with t as (select row_id, regexp_extract_all(label, '[A-Za-z0-9]+') as t, regexp_split_to_array(label, '[A-Za-z0-9]+') as g from labels where label is not null), u as (select row_id, t, g, unnest(range(1, len(t) + 1)) as place from t)
select row_id, cast(place as integer) as place, t[place] as token, cast(list_sum(list_transform(g[1:place], lambda x: length(x))) + coalesce(list_sum(list_transform(t[1:place - 1], lambda x: length(x))), 0) as integer) as start, cast(list_sum(list_transform(g[1:place], lambda x: length(x))) + list_sum(list_transform(t[1:place], lambda x: length(x))) as integer) as "end" from u""",
    "text_variant_keys": f"""with t as (select row_id, {toks_sql('label')} as t from labels where label is not null), s as (select row_id, t, list_transform(t, lambda x: {_stem_sql('x')}) as s from t where len(t) > 0),
p as (select row_id, t, s, list_slice(list_filter(range(1, len(t) + 1), lambda i: t[i] <> s[i]), 1, 3) as pl from s), m as (select *, unnest(range(0, cast(power(2, len(pl)) as bigint))) as mask from p)
select distinct row_id, array_to_string(list_transform(range(1, len(t) + 1), lambda i: case when list_position(pl, i) > 0 and (mask >> cast(list_position(pl, i) - 1 as bigint)) & 1 = 1 then s[i] else t[i] end), ' ') as key from m""",
    "text_content_tokens": f"select row_id, array_to_string(c, ' ') as content, array_to_string(list_filter(c, lambda x: length(x) >= 5 or regexp_matches(x, '[0-9]')), ' ') as specific from (select row_id, {_content} as c from query_rows)",
    "query_expansions": "select * from (select row_id, nullif(concat_ws(' ', " + ", ".join(f"case when regexp_matches(lower(search_term), '{p}') then '{e}' end" for p, e in X.EXPANSIONS.items()) + "), '') as expanded from query_rows) where expanded is not null",
    "mention_contexts": r"select * from (select row_id, list_filter(regexp_split_to_array(text, '[.!?]\s+'), lambda x: contains(lower(x), 'protocol'))[1] as context from long_document_chunks where text is not null) where context is not null",
    "denial_penalties": f"""with d as (select doc_id, {toks_sql('text')} as t from documents where text is not null), p as (select doc_id, t, unnest(list_filter(range(1, len(t) + 1), lambda i: t[i] in ({_DENY}))) as i from d),
w as (select doc_id, t, i, unnest(range(1, 7)) as n from p), x as (select doc_id, t[i + n] as token, case when n <= 2 then 0.52 when n <= 4 then 0.40 else 0.24 end as penalty, list_filter(t[i + 1:i + n], lambda y: y in ('but', 'however', 'although', 'except')) as stop from w where i + n <= len(t))
select doc_id, token, cast(max(penalty) as double) as penalty from x where len(stop) = 0 and token not in ({_STOP}) and token not in ({_DENY}) group by all""",
    "label_attributes": "select distinct row_id, attribute, value from (" + " union all ".join(f"select row_id, '{a}' as attribute, '{v}' as value from labels where regexp_matches(lower(label), '{p}')" for a, ws in X.ATTRIBUTES.items() for v, p in ws.items()) + ")",
    "new_concepts": f"""with t as (select row_id, {toks_sql('search_term')} as t from query_rows), g as (select row_id, t, unnest(range(1, len(t) + 1)) as i from t), h as (select row_id, t, i, unnest([2, 3]) as n from g),
p as (select distinct row_id, array_to_string(t[i:i + n - 1], ' ') as phrase from h where i + n - 1 <= len(t) and t[i] not in ({_STOP}) and t[i + n - 1] not in ({_STOP}) and coalesce(case when i > 1 then t[i - 1] end, '') not in ({_DENY})),
c as (select phrase, count(*) as support from p where not regexp_matches(phrase, '[0-9]') group by 1 having count(*) >= 3)
select phrase, support, {_case("string_split(phrase, ' ')[-1]", X.WORD_KINDS, 'other')} as kind, case when support >= 20 then 'propose' when support >= 8 then 'review' else 'watch' end as decision from c where phrase not in (select {key_sql('label')} from labels where label is not null)""",
    "association_pairs": f"""with {_C}, a as (select a.cui as subject, b.cui as object, count(distinct a.row_id) as n_rows, min(abs(a.pos - b.pos)) as nearest from v a join v b on a.row_id = b.row_id and a.field = 'expected_cuis' and b.field = 'context_cuis' and a.cui <> b.cui group by all),
e as (select cui, count(*) as e from evidence group by 1)
select subject, object, n_rows, nearest, case when nearest = 0 then 'same place' when n_rows >= 2 then 'recurrent' else 'single' end as kind, round(n_rows / (1.0::double + nearest) + 0.1::double * log10(1.0::double + coalesce(e, 0)), 6) as score from a left join e on e.cui = object""",
    "concept_set_edges": f"""with {_C}, i as (select distinct row_id, cui from v a where field = 'context_cuis' and not exists (select 1 from v b where b.field = 'disallowed_cuis' and b.row_id = a.row_id and b.cui = a.cui)),
w as (select distinct source_cui, target_cui from related_concepts where rela in ('isa', 'part_of') and source_cui <> target_cui), u as (select row_id, cui from i union select row_id, target_cui from i join w on w.source_cui = i.cui),
x as (select distinct row_id, cui from v where field = 'expected_cuis')
select u.cui as subject, x.cui as object, count(*) as n, round(1.0 - 1.0::double / (1 + count(*)), 6) as confidence from u join x using (row_id) where u.cui <> x.cui group by all""",
    "cross_namespace_terms": """with t as (select distinct term_id, namespace, x as cui from (select term_id, namespace, unnest(xrefs) as x from obo_terms where term_id is not null and namespace is not null) where x is not null),
e as (select source_cui, target_cui, max(case when strength is null or isnan(strength) then 0.0 else strength end) as s from relationship_edges group by all),
j as (select a.term_id, a.namespace, b.namespace as other_namespace, b.term_id as other_id, s from t a join e on e.source_cui = a.cui join t b on b.cui = e.target_cui where a.namespace <> b.namespace)
select term_id, namespace, other_namespace, other_id, cast(s as double) as strength from j qualify row_number() over (partition by term_id, namespace, other_namespace order by s desc, other_id) = 1""",
    "edges_resolved": "with b as (select x as cui, min(term_id) as term_id from (select term_id, unnest(xrefs) as x from obo_terms where term_id is not null) where x is not null group by 1) select row_id, s.term_id as subject_term, o.term_id as object_term from relationship_edges e join b s on s.cui = e.source_cui join b o on o.cui = e.target_cui",
    "term_names": "with n as (select row_id, list_filter(list_concat([name], coalesce(synonyms, [])), lambda x: x is not null) as n from obo_terms) select row_id, array_to_string(list_filter(n, lambda x, i: list_position(list_transform(n, lambda y: lower(y)), lower(x)) = i), '|') as names from n",
    "evidence_first_seen": f"""with o as (select cui, view, coalesce(weight, 1.0) as w, row_id from evidence where text is not null qualify row_number() over (partition by cui, view, {key_sql('text')} order by coalesce(weight, 1.0) desc, row_id) = 1)
select cui, view, cast(row_number() over (partition by cui, view order by w desc, row_id) as integer) as place, row_id from o qualify place <= 3""",
    "definitions_by_source": f"""with e as (select cui, text, {key_sql('text')} as key, coalesce(nullif(list_position([{', '.join(f"'{t}'" for t in X.TRUSTED)}], lower(trim(source))), 0), 99) as p from evidence where text is not null),
o as (select * from e qualify row_number() over (partition by cui, key order by p, length(text), lower(text), text) = 1)
select cui, cast(row_number() over (partition by cui order by p, length(text), lower(text), text) as integer) as place, text from o qualify place <= 2""",
    "display_names": "with o as (select x as cui, min(name) as override from (select name, unnest(xrefs) as x from obo_terms where name is not null) where x is not null group by 1), l as (select cui, min(label) as label from labels where cui is not null and label is not null group by 1) select cui, coalesce(override, label) as display, override is not null as overridden from l left join o using (cui)",
    "guarded_counts": f"select case when unique_users is null then 'no_count' when unique_users < 5 then 'too_few' when regexp_matches(coalesce(search_term, ''), '{X.PERSONAL}') then 'personal' else 'kept' end as verdict, count(*) as n from query_rows group by 1",
    "public_concepts": "select cui, count(distinct lower(trim(source))) as n_sources from evidence group by 1 having bool_and(coalesce(lower(trim(source)) in ('pubmed', 'query_log'), false))",
    "query_rotation": """with q as (select row_id, search_term from query_rows where search_term is not null), a as (select row_id from q order by md5('1/' || row_id) limit 50), b as (select row_id from q where row_id not in (select row_id from a) order by md5('2/' || row_id) limit 50)
select row_id, search_term from q where row_id not in (select row_id from a union all select row_id from b) order by md5('3/' || row_id) limit 50""",
}
from termloom.plans.text import SQL as _TEXT  # noqa: E402

SQL["documents_embedded"] = f"with h as ({_TEXT['hash_embedding']}) select row_id, count(*) as n_numbers, round(sum(value), 4) as total, any_value(sha256(label)) as text_hash from h join labels using (row_id) group by 1"
