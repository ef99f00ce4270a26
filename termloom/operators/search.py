"""Retrieval: nearest vectors of a set of queries, and BM25 over an inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries scored at a time; their vectors are the only thing sent to the executors.
QUERY_BLOCK = 2048


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, cui, score, rank): for each query (query, v) the ``k`` concepts whose best vector (row_id, cui, v) has
    the highest cosine similarity; ties go to the smaller concept. A vector never finds itself (row_id = query).
    Vectors must be finite, of one length and not all zero. Queries come in blocks, against all rows."""
    n = queries.count()
    blocks = max(1, -(-n // (QUERY_BLOCK // 2)))  # by hash, so a block may hold somewhat more than its share
    out = []
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) if blocks > 1 else queries
        out.append(_score(block.toPandas().sort_values("query"), vectors, k))
    found = reduce(DataFrame.unionByName, out)
    best = found.groupBy("query", "cui").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cui"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _score(block: pd.DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    ids = block["query"].to_numpy()
    q = np.stack(block["v"].to_numpy()).astype(np.float64) if len(block) else np.zeros((0, 1))
    q = q / np.linalg.norm(q, axis=1, keepdims=True) if len(block) else q
    held = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = held.value
        for b in batches:
            if not len(b) or not len(ids):
                continue
            v = np.stack(b["v"].to_numpy()).astype(np.float64)
            s = q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
            s[ids[:, None] == b["row_id"].to_numpy()[None, :]] = -np.inf
            # the k best concepts of a batch lie among its k best rows of each concept; keep each concept's best
            cuis, code = np.unique(b["cui"].to_numpy().astype(str), return_inverse=True)
            order = np.argsort(code, kind="stable")
            top = np.maximum.reduceat(s[:, order], np.flatnonzero(np.diff(code[order], prepend=-1)), axis=1)
            m = min(k, len(cuis))
            edge = -np.partition(-top, m - 1, axis=1)[:, m - 1 : m]
            qi, ci = np.nonzero((top >= edge) & np.isfinite(top))
            yield pd.DataFrame({"query": ids[qi], "cui": cuis[ci], "score": top[qi, ci]})

    return vectors.select("row_id", "cui", "v").mapInPandas(run, "query long, cui string, score double")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of all documents (doc, terms) that hold a term of a query (query, terms).

    Only postings of terms that occur in a query are shuffled; the query side is reduced to distinct terms first.
    """
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean"))
    n, mean = stats.first()
    wanted = queries.select("query", F.explode(F.array_distinct("terms")).alias("term"))
    post = docs.select("doc", F.size("terms").alias("len"), F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (mean or 1.0)))
    return post.join(df, "term").join(wanted, "term").groupBy("query", "doc").agg(F.sum(weight).alias("score"))
