"""Re-ranking of hits: additive score with named addends, cutoffs, specificity, confidence, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def addends() -> dict[str, Column]:
    """Named addends of the score over hits (vector_score, relevance, exact, evidence_count, qualified)."""
    return {
        "vector": 0.12 * clip((F.col("vector_score") - 0.72) / 0.18),
        "label": F.when(F.col("relevance") > 0, 0.03 + 0.04 * clip((F.col("relevance") - 0.90) / 0.45)).otherwise(0.0),
        "exact": F.when(F.col("exact"), 0.18).otherwise(0.0),
        "evidence": F.when(F.col("evidence_count") > 0, 0.04).otherwise(-0.10),
        "unqualified": F.when(F.col("qualified"), 0.0).otherwise(-0.25),
    }


def score(hits: DataFrame, parts: dict[str, Column] | None = None) -> DataFrame:
    """``hits`` with one column per addend and their sum ``rank_score``; a rule is one more entry in ``parts``."""
    parts = parts or addends()
    scored = hits.select("*", *(c.alias(f"add_{n}") for n, c in parts.items()))
    return scored.withColumn("rank_score", sum((F.col(f"add_{n}") for n in parts), F.lit(0.0)))


def cutoff(hits: DataFrame, filters: list[Column]) -> DataFrame:
    """Each filter in turn, but only where it leaves a query at least one hit."""
    for n, keep in enumerate(filters):
        flag = f"__keep{n}"
        hits = hits.withColumn(flag, F.coalesce(keep, F.lit(False)))
        hits = hits.withColumn("__left", F.sum(F.col(flag).cast("int")).over(Window.partitionBy("query"))).where(F.col(flag) | (F.col("__left") == 0)).drop(flag, "__left")
    return hits


def less_specific(hits: DataFrame, penalty: float) -> DataFrame:
    """(query, cui, penalty) of hits (query, cui, tokens) whose tokens are a strict subset of another hit's in the same
    query. Rivals are met by token, so hits without a common token are never compared."""
    h = hits.select("query", "cui", F.array_distinct("tokens").alias("tokens")).where(F.size("tokens") > 0)
    own = h.select("query", "cui", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    rival = h.select("query", F.col("cui").alias("rival"), F.size("tokens").alias("m"), F.explode("tokens").alias("t"))
    shared = own.join(rival, ["query", "t"]).where("cui <> rival and m > n").groupBy("query", "cui", "n", "rival").agg(F.count("*").alias("c"))
    return shared.where("c = n").groupBy("query", "cui").agg(F.count("*").alias("rivals")).withColumn("penalty", F.lit(penalty))


def confidence(rank_score: Column, exact: Column, evidence_count: Column) -> Column:
    """struct(score, level): confidence in a hit from its score, an exact match and its evidence."""
    value = clip(0.20 + 0.42 * clip((rank_score - 0.05) / 0.35) + F.when(exact, 0.14).otherwise(0.0) + F.when(evidence_count > 0, 0.12).otherwise(0.0))
    return T.let(value, lambda v: F.struct(F.round(v, 6).alias("score"), F.when(v >= 0.7, "high").when(v >= 0.45, "medium").otherwise("low").alias("level")))


def diverse(hits: DataFrame, most: int) -> DataFrame:
    """The ``most`` hits of each query in an order that first covers new query tokens, then fills up by score. Hits
    (query, cui, covered, rank_score); a query's hits are gathered, so cut them to a pool first."""
    import pandas as pd

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["rank_score", "cui"], ascending=[False, True])
        seen: set = set()
        first, rest = [], []
        for r in g.itertuples():
            new = set(r.covered) - seen
            (first if new else rest).append(r)
            seen |= new
        chosen = (first + rest)[:most]
        return pd.DataFrame([(r.query, r.cui, i) for i, r in enumerate(chosen, 1)], columns=["query", "cui", "place"])

    return hits.select("query", "cui", "covered", "rank_score").groupBy("query").applyInPandas(pick, f"query {hits.schema['query'].dataType.simpleString()}, cui string, place int")


def pairwise_weights(rows: DataFrame, features: list[str], bound: int = 200_000, epochs: int = 8, rate: float = 0.05, decay: float = 1e-4) -> dict[str, float]:
    """Weights of a linear ranker that puts relevant rows (query, relevant, features) above others of the same query
    (pairwise hinge loss), fitted on at most ``bound`` pairs in the order of their hash."""
    import numpy as np

    good, bad = rows.where("relevant"), rows.where("not relevant")
    pairs = good.select("query", *(F.col(f).alias(f"a_{f}") for f in features)).join(bad.select("query", *(F.col(f).alias(f"b_{f}") for f in features)), "query")
    deltas = pairs.select(*((F.col(f"a_{f}") - F.col(f"b_{f}")).alias(f) for f in features))
    x = deltas.withColumn("h", F.xxhash64(*features)).orderBy("h").limit(bound).select(*features).toPandas().to_numpy(float)
    w = np.zeros(len(features))
    for _ in range(epochs):
        for chunk in np.array_split(x, max(1, len(x) // 256)):
            wrong = chunk[chunk @ w < 1.0]
            w = w * (1 - rate * decay) + (rate * wrong.mean(axis=0) if len(wrong) else 0.0)
    return {f: round(float(v), 6) for f, v in zip(features, w, strict=True)}
