"""Text, identifier and weighting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import ids
from termloom.functions import text as T
from termloom.operators.packed import unpack
from termloom.session import table

PACKED = ["expected_cuis", "disallowed_cuis", "context_cuis"]


def text_normalized_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels", "row_id", "label").select("row_id", T.normalized_key(F.col("label")).alias("key"))


def text_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


def text_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence", "text").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def text_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels", "label").select(F.explode(T.feature_tokens(F.col("label"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def text_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of one to three words that neither begin nor end with a stopword."""
    grams = table(spark, sf, "evidence", "text").select(F.explode(T.ngrams(T.tokens(F.col("text")), 3)).alias("g"))
    edge = ~F.substring_index("g.text", " ", 1).isin(T.STOPWORDS) & ~F.substring_index("g.text", " ", -1).isin(T.STOPWORDS)
    return grams.where(edge).groupBy(F.col("g.text").alias("phrase")).agg(F.count("*").alias("n"))


def text_stems(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence", "text").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct().select("token", T.stem(F.col("token")).alias("stem"))


def text_privacy_flags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "query_rows", "row_id", "search_term").select("row_id", F.array_join(T.privacy_flags(F.col("search_term")), ",").alias("flags"))


def text_display_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels", "row_id", "label").select("row_id", T.display_label(F.col("label")).alias("display"))


def text_label_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Each piece of evidence against the first label of its concept."""
    first = table(spark, sf, "labels", "cui", "label").where("label is not null").groupBy("cui").agg(F.min("label").alias("label"))
    pairs = table(spark, sf, "evidence", "row_id", "cui", "text").join(first, "cui")
    return pairs.select("row_id", F.round(T.label_relevance(T.tokens(F.col("text")), T.tokens(F.col("label"))), 6).alias("score"))


def ids_stable(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence", "row_id", "source", "cui", "text").select("row_id", ids.stable_id("EVID_", F.col("source"), F.col("cui"), F.col("text")).alias("id"))


def ids_types(spark: SparkSession, sf: str) -> DataFrame:
    values = unpack(table(spark, sf, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED)
    return values.groupBy("field", ids.identifier_type(F.substring_index("val", "=", 1)).alias("kind")).agg(F.count("*").alias("n"))


def ids_system_codes(spark: SparkSession, sf: str) -> DataFrame:
    values = unpack(table(spark, sf, "search_quality_patient_portal_queries", "row_id", *PACKED), "row_id", PACKED)
    return values.withColumn("c", ids.system_code(F.col("val"))).where("c is not null").select("row_id", "field", "pos", "c.system", "c.code")


def text_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vector_records", "row_id", "doc_id", "text").select("row_id", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def idf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse document frequency of each token, ln((1 + N) / (1 + df)) + 1."""
    docs = table(spark, sf, "evidence", "text").where("text is not null")
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.select("token", "df", F.round(F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0, 6).alias("idf"))


def hash_embedding(spark: SparkSession, sf: str, dims: int = 64) -> DataFrame:
    """Feature hashing: index from the first 8 hex digits of a token's MD5, sign from its last digit, 1 + ln tf,
    scaled to length 1; one row per non-zero entry."""
    tok = table(spark, sf, "labels", "row_id", "label").select("row_id", F.explode(T.tokens(F.col("label"))).alias("t")).groupBy("row_id", "t").agg(F.count("*").alias("tf"))
    h = tok.withColumn("h", F.md5("t"))
    index = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dims).cast("int")
    sign = F.when(F.conv(F.substring("h", 32, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    entries = h.groupBy("row_id", index.alias("idx")).agg(F.sum(sign * (1.0 + F.log("tf"))).alias("x")).where("abs(x) > 1e-12")
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("row_id")))
    return entries.select("row_id", "idx", F.round(F.col("x") / norm, 6).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (text_normalized_key, text_clean, text_token_counts, text_features, text_ngrams, text_stems, text_privacy_flags, text_display_label, text_label_relevance, ids_stable, ids_types, ids_system_codes, text_manifest, idf_weights, hash_embedding)
}

_A, _B = (s.replace("'", "''") for s in T.fold_pairs())


def key_sql(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(translate({c}, '{_A}', '{_B}'), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def toks_sql(c: str) -> str:
    return f"list_filter(string_split({key_sql(c)}, ' '), lambda x: x <> '')"


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _undouble(s: str) -> str:
    return f"case when length({s}) >= 2 and right({s}, 1) = substr({s}, length({s}) - 1, 1) then left({s}, length({s}) - 1) else {s} end"


def _system(c: str) -> str:
    return f"case upper(trim({c})) " + " ".join(f"when '{a}' then '{b}'" for a, b in ids.SYSTEM_ALIASES.items()) + f" else upper(trim({c})) end"


def _values_sql() -> str:
    from termloom.plans.preparation import SQL as PREPARED

    return PREPARED["p4_found"]


SQL = {
    "text_normalized_key": f"select row_id, {key_sql('label')} as key from labels",
    "text_clean": r"select doc_id, regexp_replace(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')), ' ([,.;:!?])', '\1', 'g') as clean from documents",
    "text_token_counts": f"select token, count(*) as n from (select unnest({toks_sql('text')}) as token from evidence) group by 1",
    "text_features": f"""with t as (select {toks_sql('label')} as t from labels where label is not null), f as (select t, array_to_string(t, '') as s from t)
select feature, count(*) as n from (select unnest(t) as feature from f union all select unnest(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: substr(s, i, 3))) from f where length(s) >= 3
union all select unnest(list_transform(range(1, greatest(length(s) - 2, 1)), lambda i: substr(s, i, 4))) from f where length(s) >= 4) group by 1""",
    "text_ngrams": f"""with t as (select {toks_sql('text')} as t from evidence), g as (select t, unnest(range(1, len(t) + 1)) as i from t), h as (select t, i, unnest([1, 2, 3]) as n from g)
select array_to_string(t[i:i + n - 1], ' ') as phrase, count(*) as n from h where i + n - 1 <= len(t) and t[i] not in ({_STOP}) and t[i + n - 1] not in ({_STOP}) group by 1""",
    "text_stems": f"""with t as (select distinct unnest({toks_sql('text')}) as token from evidence)
select token, case when token like '%ies' and length(token) > 4 then left(token, length(token) - 3) || 'y' when token like '%ves' and length(token) > 5 then left(token, length(token) - 3) || 'f'
when token like '%ing' and length(token) > 6 then {_undouble('left(token, length(token) - 3)')} when token like '%ed' and length(token) > 5 then {_undouble('left(token, length(token) - 2)')}
when token like '%s' and length(token) > 4 and not regexp_matches(token, '(ss|us|is)$') and token not in ('diabetes', 'herpes', 'rabies', 'always', 'series') then left(token, length(token) - 1) else token end as stem from t""",
    "text_privacy_flags": "select row_id, array_to_string(list_filter(["
    + ", ".join(f"case when regexp_matches(search_term, '{p}') then '{n}' end" for n, p in T.PRIVACY_PATTERNS.items())
    + "], lambda x: x is not null), ',') as flags from query_rows",
    "text_display_label": "with p as (select row_id, label, list_filter(list_transform(string_split(label, ';'), lambda x: trim(x, ' ')), lambda x: x <> '') as p from labels) select row_id, case when contains(label, ';') and len(p) = 2 then p[2] || ' ' || p[1] else label end as display from p",
    "ids_stable": "select row_id, 'EVID_' || left(sha1(coalesce(source, '') || chr(9) || coalesce(cui, '') || chr(9) || coalesce(text, '')), 20) as id from evidence",
    "ids_types": "select field, case "
    + " ".join(f"when regexp_matches(upper(trim(split_part(val, '=', 1))), '{p}') then '{n}'" for n, p in ids.IDENTIFIER_FORMS.items())
    + f" else '' end as kind, count(*) as n from ({_values_sql()}) group by all",
    "ids_system_codes": f"""select row_id, field, pos, {_system("regexp_extract(val, '" + ids.SYSTEM_CODE + "', 1)")} as system, trim(regexp_extract(val, '{ids.SYSTEM_CODE}', 2)) as code from ({_values_sql()}) where regexp_matches(trim(val), '{ids.SYSTEM_CODE}')""",
    "text_manifest": "select row_id, doc_id, sha256(coalesce(text, '')) as text_hash, length(coalesce(text, '')) as n_chars from vector_records",
    "idf_weights": f"""with d as (select {toks_sql('text')} as t from evidence where text is not null), n as (select count(*) as n from d)
select token, count(*) as df, round(ln((1.0::double + any_value(n.n)) / (1.0::double + count(*))) + 1.0, 6) as idf from (select unnest(list_distinct(t)) as token from d), n group by token""",
    "hash_embedding": f"""with t as (select row_id, unnest({toks_sql('label')}) as t from labels), c as (select row_id, t, count(*) as tf, md5(t) as h from t group by all),
e as (select row_id, cast(cast('0x' || left(h, 8) as bigint) % 64 as integer) as idx, sum(case when cast('0x' || right(h, 1) as int) % 2 = 0 then 1.0::double else -1.0::double end * (1.0::double + ln(tf))) as x from c group by all)
select row_id, idx, round(x / sqrt(sum(x * x) over (partition by row_id)), 6) as value from e where abs(x) > 1e-12""",
    "text_label_relevance": f"""with f as (select cui, min(label) as label from labels where label is not null group by cui),
p as (select e.row_id, {toks_sql('e.text')} as q, list_filter({toks_sql('f.label')}, lambda x, i: list_position({toks_sql('f.label')}, x) = i) as l from evidence e join f using (cui)),
m as (select row_id, q, l, len(list_filter(l, lambda x: list_contains(q, x))) as m, list_reduce(q, lambda i, t: case when l[cast(i as bigint) + 1] = t then cast(cast(i as bigint) + 1 as varchar) else i end, '0') as taken from p)
select row_id, round(case when q is null or len(l) = 0 or m = 0 then 0.0::double when m = len(l) then 0.60::double + 0.10::double * least(len(l), 5) + case when cast(taken as bigint) = len(l) then 0.08::double else 0 end
+ case when contains(' ' || array_to_string(q, ' ') || ' ', ' ' || array_to_string(l, ' ') || ' ') then 0.05::double else 0 end else 0.25::double + 0.35::double * m / len(l) + 0.03::double * least(m, 4) end, 6) as score from m""",
}
