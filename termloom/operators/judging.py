"""Judged search: coverage with alternatives, shares of sources, gates, decisions, joined judgments, retrieval metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTHS = (5, 10, 20, 60)


def _best(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query", "cui").agg(F.min("rank").alias("rank"))


def coverage(hits: DataFrame, expected: DataFrame, disallowed: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Per query the share of expected concepts that stand, or an acceptable alternative (cui, other) of which stands,
    among the first 5, 10, 20 and 60 hits; how many disallowed ones are among the first ten; and the verdict: good with
    four fifths in ten and none disallowed, mixed with any in twenty, else poor. Queries without expected concepts do
    not come out."""
    best = _best(hits)
    want = expected.select("query", "cui").distinct()
    own = want.join(best, ["query", "cui"], "left")
    other = want.join(alternatives, "cui").join(best.select("query", F.col("cui").alias("other"), "rank"), ["query", "other"]).select("query", "cui", "rank")
    rank = own.unionByName(other).groupBy("query", "cui").agg(F.min("rank").alias("rank"))
    shares = rank.groupBy("query").agg(*(F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 6).alias(f"coverage_{k}") for k in DEPTHS))
    bad = best.where("rank <= 10").join(disallowed.select("query", "cui").distinct(), ["query", "cui"]).groupBy("query").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    verdict = F.when((F.col("coverage_10") >= 0.8) & (n == 0), "good").when(F.col("coverage_20") > 0, "mixed").otherwise("poor")
    return shares.join(bad, "query", "left").select("query", *(f"coverage_{k}" for k in DEPTHS), n.alias("disallowed_10"), verdict.alias("verdict"))


def by_source(hits: DataFrame, expected: DataFrame, disallowed: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source of the hits' concepts (cui, source): hits, expected and disallowed ones among them, best rank."""
    flag = lambda d, n: d.select("query", "cui").distinct().withColumn(n, F.lit(1))
    j = _best(hits).join(sources, "cui").join(flag(expected, "good"), ["query", "cui"], "left").join(flag(disallowed, "bad"), ["query", "cui"], "left")
    return j.groupBy("source").agg(F.count("*").alias("hits"), F.count("good").alias("expected_hits"), F.count("bad").alias("bad_hits"), F.min("rank").alias("best_rank"))


def collapsed(now: DataFrame, before: DataFrame, least: float) -> DataFrame:
    """A gate a source (source, n): it must keep the share ``least`` of its rows; a source that is gone fails."""
    both = now.withColumnRenamed("n", "now").join(before.withColumnRenamed("n", "before"), "source", "full_outer")
    value = F.coalesce("now", F.lit(0)).cast("double")
    return both.select(F.concat(F.lit("source_collapse:"), "source").alias("gate"), value.alias("value"), (value >= least * F.coalesce("before", F.lit(0))).alias("passed"))


def bounds(values: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """A gate for each named value (one row, a column each): not below its least, not above its most; null fails."""
    parts = []
    for name, (low, high) in limits.items():
        ok = F.lit(True) if low is None else F.col(name) >= low
        ok = ok if high is None else ok & (F.col(name) <= high)
        parts.append(values.select(F.lit(name).alias("gate"), F.col(name).cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return reduce(DataFrame.unionByName, parts)


def unit_decisions(judged: DataFrame) -> DataFrame:
    """Per unit (cui, part dev or held_out, grade 1, -1 or 0) its counts in both parts and the decision: promote what is
    good in dev and bad in neither, quarantine what is bad only, demote what is bad more often than good."""
    count = lambda p, g: F.count_if((F.col("part") == p) & (F.col("grade") == g))
    c = judged.groupBy("cui").agg(*(count(p, g).alias(f"{p}_{n}") for p in ("dev", "held_out") for n, g in (("good", 1), ("bad", -1), ("open", 0))))
    decision = F.when((F.col("dev_bad") == 0) & (F.col("dev_good") >= 2) & (F.col("held_out_bad") == 0), "promote").when((F.col("dev_good") == 0) & (F.col("dev_bad") >= 2), "quarantine").when(F.col("dev_bad") > F.col("dev_good"), "demote")
    return c.withColumn("decision", F.coalesce(decision, F.lit("neutral")))


def joined(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """Hits with the grade of the judgment (query, cui, grade, order) that comes last; without one it is null."""
    last = judgments.groupBy("query", "cui").agg(F.max_by("grade", "order").alias("grade"))
    return _best(hits).join(last, ["query", "cui"], "left").select("query", "cui", "rank", "grade")


def retrieval(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """Per topic of a run (topic, doc, rank) against judgments (topic, doc, grade): retrieved, judged, precision and
    judged share at each depth, reciprocal rank and recall. What is not judged counts neither way, and recall is null
    where nothing relevant is known."""
    x = run.join(qrels.select("topic", "doc", "grade"), ["topic", "doc"], "left")
    known = qrels.groupBy("topic").agg(F.count_if(F.col("grade") > 0).alias("relevant"))
    good = F.col("grade") > 0
    at = [c for k in depths for c in (F.round(F.count_if((F.col("rank") <= k) & good) / k, 6).alias(f"precision_{k}"), F.round(F.count_if((F.col("rank") <= k) & F.col("grade").isNotNull()) / k, 6).alias(f"judged_{k}"))]
    rows = x.groupBy("topic").agg(F.count("*").alias("retrieved"), F.count("grade").alias("judged"), *at, F.min(F.when(good, F.col("rank"))).alias("first"), F.count_if(good).alias("found"))
    out = rows.join(known, "topic", "left")
    return out.select("topic", "retrieved", "judged", *(f"{m}_{k}" for k in depths for m in ("precision", "judged")), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")), 6).alias("recall"))
