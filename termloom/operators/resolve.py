"""Free text to concepts: identifiers, codes and phrases, scored; mentions that no longer mention encloses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.link import spans

IDENTIFIER = r"\b([Cc]\d{7})\b"
SYSTEM_CODE = r"\b([A-Z]{2,8}:[0-9]{2,12})\b"
#: A code without its system: digits that no letter, colon or further digit adjoins.
BARE_CODE = r"(?<![\w:.-])([0-9]{4,12})(?![\w:.-])"


def resolve_text(docs: DataFrame, names: DataFrame, concepts: DataFrame, codes: DataFrame, most_tokens: int) -> DataFrame:
    """(doc, target, score, how): what the texts of docs (doc, text) refer to, the best score of each target.

    Identifiers that are among ``concepts`` (cui) score 100; codes of a named system among ``codes`` (system, code, cui)
    96, their bare codes, if only one concept has them, 88; names (key, cui, n_tokens) 70 and 3 for each token, 15 more
    if the name is the whole text. Identifiers and codes that nothing knows come out as such with score 0.
    """
    each = lambda pattern: docs.select("doc", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), F.upper))).alias("target"))
    known = concepts.select(F.upper("cui").alias("target")).distinct().withColumn("there", F.lit(True))
    direct = each(IDENTIFIER).join(known, "target", "left").select("doc", "target", F.when(F.col("there"), 100).otherwise(0).alias("score"), F.when(F.col("there"), "identifier").otherwise("unknown").alias("how"))
    full = codes.select(F.concat_ws(":", "system", "code").alias("target"), F.col("cui").alias("resolved")).distinct()
    coded = each(SYSTEM_CODE).join(full, "target", "left").select("doc", F.coalesce("resolved", "target").alias("target"), F.when(F.col("resolved").isNull(), 0).otherwise(96).alias("score"), F.when(F.col("resolved").isNull(), "unknown").otherwise("code").alias("how"))
    alone = codes.groupBy("code").agg(F.min("cui").alias("cui"), F.countDistinct("cui").alias("n")).where("n = 1")
    bare = each(BARE_CODE).join(alone, F.col("target") == F.col("code")).select("doc", F.col("cui").alias("target"), F.lit(88).alias("score"), F.lit("bare code").alias("how"))
    whole = F.size(F.split("key", " ")) == F.col("size")
    named = spans(docs, names, most_tokens).select("doc", F.col("cui").alias("target"), (70 + 3 * F.col("n_tokens") + F.when(whole, 15).otherwise(0)).alias("score"), F.lit("name").alias("how"))
    found = direct.unionByName(coded).unionByName(bare).unionByName(named).groupBy("doc", "target").agg(F.max(F.struct("score", "how")).alias("x"))
    return found.select("doc", "target", "x.score", "x.how")


def maximal(spans: DataFrame) -> DataFrame:
    """Spans (doc, start, n_tokens, ...) that no other span of the document strictly encloses; partial overlaps stay.
    Spans of one document are gathered; they are bounded by its length."""
    cols = [c for c in spans.columns if c != "doc"]
    held = spans.groupBy("doc").agg(F.collect_list(F.struct(*cols)).alias("s"))
    inside = lambda a, b: (b["start"] <= a["start"]) & (b["start"] + b["n_tokens"] >= a["start"] + a["n_tokens"]) & (b["n_tokens"] > a["n_tokens"])
    free = F.filter("s", lambda a: ~F.exists("s", lambda b: inside(a, b)))
    return held.select("doc", F.explode(free).alias("x")).select("doc", "x.*")


def span_score(n_tokens: Column, span_content: Column, query_content: Column, cuis: Column, preferred: Column) -> Column:
    """Score of a span as an answer to a whole query: by the share of the query it covers, how rare its name is, and
    whether the name is preferred."""
    share = span_content / F.greatest(query_content, F.lit(1))
    rare = F.when(cuis <= 3, 0.15).when(cuis >= 20, -0.15).otherwise(0.0)
    liked = F.when(preferred, 0.02).otherwise(0.0)
    return (
        F.when(span_content >= query_content, 1.05 + 0.12 * F.least(n_tokens, F.lit(5)) + rare + liked)
        .when(span_content == 1, 0.68 + 0.15 * share + 0.30 * rare + liked)
        .otherwise(0.78 + 0.35 * share + 0.04 * F.least(n_tokens, F.lit(4)) + rare + liked)
    )
