"""Dictionary span join: text to the concepts whose labels it mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators.namebits import possible


# Words that name no concept when they stand alone.
GENERIC = ["case", "cases", "disease", "finding", "normal", "other", "patient", "patients", "problem", "report", "result", "results", "symptoms", "test", "therapy", "treatment", "unspecified"]


def dictionary(labels: DataFrame, most_tokens: int, ambiguity: int) -> DataFrame:
    """(key, cui, n_tokens) of the labels (label, cui) fit for linking: two tokens or one of at least four letters that
    is no generic word, at most ``most_tokens``, with a letter, no stop word at either edge, naming at most
    ``ambiguity`` concepts, of which the lowest is taken."""
    keyed = labels.select(T.once(T.normalized_key(F.col("label"))).alias("key"), "cui").where(F.col("key").rlike("[a-z]"))
    one = keyed.groupBy("key").agg(F.countDistinct("cui").alias("n"), F.min("cui").alias("cui")).where(F.col("n") <= ambiguity)
    size = F.size(F.split("key", " "))
    words = F.split("key", " ")
    edges = ~F.element_at(words, 1).isin(T.STOPWORDS) & ~F.element_at(words, -1).isin(T.STOPWORDS)
    return one.where((size <= most_tokens) & edges & ((size > 1) | (F.length("key") >= 4) & ~F.col("key").isin(GENERIC))).select("key", "cui", size.alias("n_tokens"))


def spans(docs: DataFrame, names: DataFrame, most_tokens: int) -> DataFrame:
    """(doc, start, n_tokens, key, cui, size, content) of every run of tokens in docs (doc, text) that is a name, with the
    number of the document's tokens and of those that are no stop words. Only runs that may be names are shuffled."""
    return possible(docs, names, most_tokens).join(names, "key").select("doc", "start", "n_tokens", "key", "cui", "size", "content")


def candidates(docs: DataFrame, names: DataFrame, most_tokens: int) -> DataFrame:
    """(doc, start, n_tokens, key, cui) of every run of tokens in docs (doc, text) that is a name."""
    return spans(docs, names, most_tokens).drop("size", "content")


def longest(spans: Column) -> Column:
    """Left to right the longest of the spans (struct start, length, ...) that begin behind the last one taken."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["length"] - a["length"]))
    start = F.struct(F.lit(0).alias("end"), F.slice(order, 1, 0).alias("taken"))
    step = lambda acc, s: F.when(s["start"] > acc["end"], F.struct((s["start"] + s["length"] - 1).alias("end"), F.concat(acc["taken"], F.array(s)).alias("taken"))).otherwise(acc)
    return F.aggregate(order, start, step, lambda acc: acc["taken"])


def link(docs: DataFrame, names: DataFrame, most_tokens: int, per_concept: int) -> DataFrame:
    """(doc, cui, n_mentions, first_start, key): longest matches, overlaps resolved from the left, at most
    ``per_concept`` mentions of a concept counted in a document. Spans of one document are gathered; they are
    bounded by its length."""
    spans = candidates(docs, names, most_tokens).groupBy("doc").agg(F.collect_list(F.struct("start", F.col("n_tokens").alias("length"), "cui", "key")).alias("spans"))
    taken = spans.select("doc", F.explode(longest(F.col("spans"))).alias("s"))
    return taken.groupBy("doc", F.col("s.cui").alias("cui")).agg(F.least(F.count("*"), F.lit(per_concept)).alias("n_mentions"), F.min("s.start").alias("first_start"), F.min_by("s.key", "s.start").alias("key"))
