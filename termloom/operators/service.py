"""What a search service asks of the tables: requests, profiles, thresholds, policies, confidence and embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions import ids
from termloom.functions import text as T
from termloom.operators import dictionary as D


@dataclass
class Request:
    """A search request: text, mode (see ``dictionary.MODES``), sources to keep, visibility, what to return and the page."""

    text: str
    mode: str = "words"
    partial: bool = False
    sources: list[str] = field(default_factory=list)
    obsolete: bool = False
    suppressible: bool = False
    returns: str = "concept"
    page: int = 1
    size: int = 25


def answer(labels: DataFrame, request: Request) -> DataFrame:
    """One page of results for a request over labels (row_id, cui, label, sab, tty, ispref, suppress): the preferred row
    of each concept, or of each concept and source with ``returns`` code, in order of fit, length and name.

    An identifier as text is looked up as such. Unknown modes and pages below 1 are refused.
    """
    if request.mode not in D.MODES or request.returns not in ("concept", "code") or request.page < 1:
        raise ValueError("unknown mode, kind of result, or page")
    seen = labels.where(D.visible(F.col("suppress"), request.obsolete, request.suppressible))
    if request.sources:
        seen = seen.where(ids.system_name(F.col("sab")).isin([s.upper() for s in request.sources]) | F.col("sab").isin(request.sources))
    wanted = request.text.strip().upper()
    by_id = seen.where((F.col("cui") == wanted) & F.col("label").isNotNull())
    found = by_id if wanted[:1] == "C" and wanted[1:].isdigit() and len(wanted) == 8 else D.search_labels(seen, request.text, request.mode, request.partial)
    best = D.best_rows(found, ["cui"] if request.returns == "concept" else ["cui", "sab"])
    fit = F.when(F.lower("label") == request.text.lower().strip(), 0).otherwise(1)
    # a page is a bounded sorted prefix, whatever the number of results
    top = best.orderBy(fit, F.length("label"), "label", "row_id").limit(request.page * request.size)
    place = F.row_number().over(Window.orderBy(fit, F.length("label"), "label", "row_id"))
    return top.withColumn("place", place).where(F.col("place") > (request.page - 1) * request.size)


def profile(types: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(cui, group) of concepts by their semantic types (cui, tui): the first group that holds one of them."""
    kinds = types.groupBy("cui").agg(F.collect_set("tui").alias("t"))
    out = F.lit("other")
    for name, members in reversed(groups.items()):
        out = F.when(F.arrays_overlap("t", F.array(*map(F.lit, members))), name).otherwise(out)
    return kinds.select("cui", out.alias("group"))


# Lowest relevance that each way of searching shows.
THRESHOLDS = {"balanced": 0.60, "comprehensive": 0.35, "filtered": 0.20}


def by_mode(hits: DataFrame, mode: str) -> DataFrame:
    return hits.where(F.col("relevance") >= THRESHOLDS[mode])


def allowed_pages(pages: DataFrame, policy: DataFrame, restricted: bool = False) -> DataFrame:
    """Pages (source, ...) whose source has a policy (source, license, restricted) that lets them in."""
    ok = policy if restricted else policy.where(~F.col("restricted"))
    return pages.join(ok.select("source", "license"), "source")


def interval_confidence(lower: Column, upper: Column, n: Column, base: float = 0.5) -> Column:
    """Confidence in an effect from its interval (ratios, so on a logarithmic scale) and its sample: more if the interval
    leaves out 1 and is narrow, and with the logarithm of the sample; between 0 and 1, null if a bound is not positive."""
    width = F.log(upper) - F.log(lower)
    clear = F.when((lower > 1) | (upper < 1), 0.2).otherwise(-0.1)
    value = base + clear - 0.1 * F.least(width, F.lit(2.0)) + 0.05 * F.log10(F.greatest(n, F.lit(1)))
    return F.when((lower > 0) & (upper >= lower), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4))


def linear_rank(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rows (query, cui, place, features) with ``ml_score`` and ``ml_rank`` within their query; ties keep their place."""
    score = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in weights.items()), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ml_score"), "place", "cui"))
    return rows.withColumn("ml_score", F.round(score, 9)).withColumn("ml_rank", rank)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256, md5) of the files of a folder, as for a release manifest."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def hash_vectors(df: DataFrame, id_column: str, text: str, dims: int = 256, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, vector) by feature hashing of tokens and character grams with BLAKE2b: index by the number, sign by its top
    bit, 1 + ln of the count (times a weight), scaled to length 1. Texts without features have the zero vector."""
    features = df.select(F.col(id_column).alias("id"), T.feature_tokens(F.coalesce(F.col(text), F.lit(""))).alias("f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b

        held: dict[str, int] = {}
        for b in batches:
            out = []
            for fs in b["f"]:
                v = np.zeros(dims)
                names, counts = np.unique(np.asarray(fs, dtype=object).astype(str), return_counts=True)
                for name, n in zip(names, counts, strict=True):
                    h = held.get(name)
                    if h is None:
                        h = held[name] = int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "big")
                    v[h % dims] += (1 + np.log(n)) * (weights or {}).get(name, 1.0) * (1 if h >> 63 else -1)
                size = np.linalg.norm(v)
                out.append((v / size if size else v).round(6).tolist())
            if len(held) > 1_000_000:
                held.clear()
            yield pd.DataFrame({"id": b["id"], "vector": out})

    return features.mapInPandas(run, f"id {df.schema[id_column].dataType.simpleString()}, vector array<double>")
