"""Whole-corpus operators: dedupe over several keys, identity filters, source subsets, redaction and pruning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.session import cut


def identity_keys(df: DataFrame) -> Column:
    """The keys by which two documents (doc_id, title, source) are the same: id, and title of 24 letters or more."""
    title = T.normalized_key(F.col("title"))
    return F.array_compact(F.array(F.concat(F.lit("id:"), F.col("doc_id").cast("string")), F.when(F.length(title) >= 24, F.concat(F.lit("title:"), title))))


def merge_first_wins(docs: DataFrame, keys: Column, order: str) -> DataFrame:
    """The documents that a pass in ``order`` keeps, where a document falls away if one of its keys belongs to a kept
    one and the keys of fallen documents do not count. (``order`` unique.)

    Fallen documents make the relation intransitive, so the pass is repeated as rounds of a well-founded game: a
    document whose keys no undecided or kept earlier document holds is kept; one that shares a key with a kept
    earlier document falls. Every round decides at least the earliest undecided document of each group.
    """
    pairs = cut(docs.select(F.col(order).alias("o"), F.explode(keys).alias("k")).distinct())
    kept = pairs.select("o").limit(0)
    open_ = pairs
    while open_.limit(1).count():
        first = open_.groupBy("k").agg(F.min("o").alias("first"))
        lead = open_.join(first, "k").groupBy("o").agg(F.min((F.col("o") == F.col("first")).cast("int")).alias("leads")).where("leads = 1").select("o")
        lead = cut(lead)
        kept = cut(kept.unionByName(lead))
        taken = open_.join(lead, "o", "left_semi").select("k").distinct()
        gone = open_.join(taken, "k", "left_semi").select("o").distinct()
        open_ = cut(open_.join(gone, "o", "left_anti"))
    return docs.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def without_known(docs: DataFrame, keys: Column, known: DataFrame) -> DataFrame:
    """Documents none of whose keys is among ``known`` (k)."""
    marked = docs.withColumn("__keys", keys).withColumn("__row", F.monotonically_increasing_id())
    hit = marked.select("__row", F.explode("__keys").alias("k")).join(known.select("k").distinct(), "k", "left_semi").select("__row").distinct()
    return marked.join(hit, "__row", "left_anti").drop("__keys", "__row")


def public_view(df: DataFrame, sources: Column, allowed: list[str], label: Column, public_label: Column) -> DataFrame:
    """Rows all of whose sources are allowed and that have a public label, which replaces the label."""
    ok = F.forall(sources, lambda s: s.isin(allowed)) & (F.size(sources) > 0) & public_label.isNotNull()
    return df.where(F.coalesce(ok, F.lit(False))).withColumn("display", F.coalesce(public_label, label))


def drop_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``drop_reason``: the name of the first rule a row meets, or empty."""
    reason = F.lit("")
    for name, rule in reversed(rules.items()):
        reason = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(reason)
    return df.withColumn("drop_reason", reason)


def blake_hash(text: Column, digits: int = 32) -> Column:
    """Hexadecimal BLAKE2b digest of a text, which has no built-in; null stays null."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        from hashlib import blake2b

        return pd.Series([None if t is None else blake2b(t.encode(), digest_size=digits // 2).hexdigest() for t in s], dtype=object)

    return digest(text)


def first_bucket(kinds: Column, buckets: dict[str, list[str]]) -> Column:
    """The first bucket that holds one of the kinds, else OTHER."""
    out = F.lit("OTHER")
    for name, members in reversed(buckets.items()):
        out = F.when(F.arrays_overlap(kinds, F.array(*map(F.lit, members))), name).otherwise(out)
    return out


def scorecard(lanes: DataFrame, caps: DataFrame) -> DataFrame:
    """One weighted score over lanes (lane, score, weight); each cap (cap, lane, below, enough, max_score) holds the total
    down to max_score if at least ``enough`` of its lanes score below ``below``."""
    total = lanes.agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("raw"))
    met = caps.join(lanes.select("lane", "score"), "lane").groupBy("cap", "enough", "max_score").agg(F.count_if(F.col("score") < F.col("below")).alias("low")).where("low >= enough").agg(F.min("max_score").alias("limit"))
    return total.withColumn("one", F.lit(1)).join(met.withColumn("one", F.lit(1)), "one").select("raw", F.least("raw", F.coalesce("limit", "raw")).alias("score"))
