"""Retrieval metrics, their summaries at several grains, gates and progress between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_metrics(hits: DataFrame, expected: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query: expected ids, how many are found, found@k, recall and reciprocal rank.

    hits (query, cui, rank), expected (query, cui); repeated ids count once, at their best rank. A query without
    hits scores 0; one without expected ids does not come out.
    """
    best = hits.groupBy("query", "cui").agg(F.min("rank").alias("rank"))
    joined = expected.select("query", "cui").distinct().join(best, ["query", "cui"], "left")
    found = [F.max(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"found_at_{k}") for k in at]
    out = joined.groupBy("query").agg(F.count("*").alias("n_expected"), F.count("rank").alias("n_found"), *found, F.min("rank").alias("first"))
    return out.withColumn("recall", F.col("n_found") / F.col("n_expected")).withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first"), F.lit(0.0))).drop("first")


def summary(rows: DataFrame, grains: list[str], at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Means over all rows and over each value of each grain on its own, in one pass: grain, value, n, ..."""
    view = rows.select(F.explode(F.array(F.struct(F.lit("all").alias("grain"), F.lit("").alias("value")), *(F.struct(F.lit(g).alias("grain"), F.coalesce(F.col(g).cast("string"), F.lit("")).alias("value")) for g in grains))).alias("g"), *(f"found_at_{k}" for k in at), "recall", "reciprocal_rank")
    means = [F.round(F.avg(f"found_at_{k}"), 6).alias(f"found_at_{k}") for k in at]
    return view.groupBy("g.grain", "g.value").agg(F.count("*").alias("n"), *means, F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def gates(current: DataFrame, baseline: DataFrame, tolerance: float) -> DataFrame:
    """Metric by metric (metric, value) whether the current run holds the baseline's value within ``tolerance``; a
    metric that is missing on either side fails."""
    both = current.withColumnRenamed("value", "current").join(baseline.withColumnRenamed("value", "baseline"), "metric", "full_outer")
    return both.withColumn("passed", F.coalesce(F.col("current") >= F.col("baseline") - tolerance, F.lit(False)))


def progression(stages: DataFrame) -> DataFrame:
    """Stages (group, stage, value, rejected) with the change since the group's first stage and since its latest
    earlier stage that was not rejected (the first, if there is none)."""
    w = Window.partitionBy("group").orderBy("stage")
    first = F.first("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = F.last(F.when(~F.col("rejected"), F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return stages.select("group", "stage", F.round(F.col("value") - first, 6).alias("since_first"), F.round(F.col("value") - F.coalesce(kept, first), 6).alias("since_kept"))
