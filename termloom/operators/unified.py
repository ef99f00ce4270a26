"""One search over free text: candidates of several lanes united by concept, scored, cut, filled in and paged.

Every lane is a DataFrame (query, cui, score); a new lane is one more entry. Candidates are merged by partial
aggregation, so a concept that every query finds is no burden, and labels and counts are brought only to the page.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions import text as T
from termloom.operators.link import spans
from termloom.session import cut_counting

#: Weight of each lane in the score of a hit.
LANES = {"label": 1.0, "code": 1.0, "definition": 0.5, "vector": 0.3, "graph": 0.2}
# Least score of a hit by mode, and least pool of candidates by mode.
MODES = {"precise": 0.60, "balanced": 0.35, "comprehensive": 0.20}
POOLS = {"precise": 40, "balanced": 80, "comprehensive": 120}
#: So many words that queries ask for and definitions hold are broadcast; beyond it they are joined.
HELD_WORDS = 200_000


def pool_size(k: int, mode: str = "balanced", times: int = 4) -> int:
    """How many candidates of a query go into the ranking for a page of ``k``."""
    return max(k, POOLS[mode], k * times)


def label_lane(queries: DataFrame, names: DataFrame, most_tokens: int) -> DataFrame:
    """Names inside the text of queries (query, text), scored by the share of its words that they cover."""
    found = spans(queries.select(F.col("query").alias("doc"), "text"), names, most_tokens)
    return found.groupBy(F.col("doc").alias("query"), "cui").agg(F.max(0.5 + 0.5 * F.col("n_tokens") / F.col("size")).alias("score"))


def code_lane(queries: DataFrame, concepts: DataFrame, pattern: str = r"\b([Cc]\d{7})\b") -> DataFrame:
    """Identifiers inside the text that are among concepts (cui)."""
    found = queries.select("query", F.explode_outer(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), F.upper))).alias("cui"))
    return found.where("cui is not null").join(concepts.select("cui").distinct(), "cui", "left_semi").select("query", "cui", F.lit(1.0).alias("score"))


def definition_lane(queries: DataFrame, definitions: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """Definitions (cui, text) that hold, as prefixes of their words, all of a query's usable words (``least`` to
    ``most``, no stop words, at least three letters), scored by the share of the definition they are.

    A query with a word that no definition holds ends there, without a shuffle if such words are no more than
    HELD_WORDS; any other is led by its rarest word to definitions, which are then asked for the rest. So common words
    bring no pairs about. A text that many concepts share is asked once."""
    usable = F.array_sort(F.filter(F.array_distinct(T.tokens(F.col("text"))), lambda t: (F.length(t) >= 3) & ~t.isin(T.STOPWORDS)))
    q = queries.select("query", T.once(usable).alias("ts")).where((F.size("ts") >= least) & (F.size("ts") <= most))
    d = definitions.select("text").distinct().select("text", T.once(F.array_distinct(T.tokens(F.col("text")))).alias("w")).where("size(w) > 0")
    starts = F.array_distinct(F.flatten(F.transform(F.filter("w", lambda x: F.length(x) >= 3), lambda x: F.transform(F.sequence(F.lit(3), F.length(x)), lambda n: F.substring(x, F.lit(1), n)))))
    post = d.select("text", F.size("w").alias("len"), F.concat(F.lit(" "), F.array_join("w", " ")).alias("def"), F.explode_outer(starts).alias("t")).where("t is not null")
    asked = q.select(F.explode("ts").alias("t")).distinct()
    often, n = cut_counting(post.groupBy("t").agg(F.count("*").alias("n")).join(asked, "t", "left_semi"), F.lit(True))
    few = n <= HELD_WORDS
    led = _rarest(q, often) if few else q.withColumn("row", F.monotonically_increasing_id()).select("row", "query", "ts", F.explode("ts").alias("t")).join(often, "t").groupBy("row", "query", "ts").agg(F.count("*").alias("held"), F.min(F.struct("n", "t")).alias("rarest")).where("held = size(ts)").select("query", "ts", F.col("rarest.t").alias("t"))
    led = led.withColumn("starts", F.transform("ts", lambda t: F.concat(F.lit(" "), t))).withColumn("size", F.size("ts")).drop("ts")
    hit = led.join(post.join(F.broadcast(often) if few else often, "t", "left_semi"), "t")
    for i in range(most):  # one by one, since a lambda over the words is many times slower
        hit = hit.where(F.coalesce(F.col("def").contains(F.get("starts", F.lit(i))), F.lit(True)))
    told = hit.select("query", "text", (F.col("size") / F.col("len")).alias("score")).join(definitions.select("cui", "text").distinct(), "text")
    return told.groupBy("query", "cui").agg(F.max("score").alias("score"))


def _rarest(q: DataFrame, often: DataFrame) -> DataFrame:
    """Queries (query, ts) whose words are all among often (t, n), each with its rarest word t."""
    held = q.sparkSession.sparkContext.broadcast({r.t: r.n for r in often.toLocalIterator()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = held.value
        for b in batches:
            asked = ((query, ts, ts.split(" ")) for query, ts in b.itertuples(index=False, name=None))
            rows = [(query, ts, min(words, key=lambda t: (n[t], t))) for query, ts, words in asked if all(t in n for t in words)]
            yield pd.DataFrame(rows, columns=["query", "ts", "t"])

    found = q.select("query", F.array_join("ts", " ").alias("ts")).mapInPandas(run, f"query {q.schema['query'].dataType.simpleString()}, ts string, t string")
    return found.select("query", F.split("ts", " ").alias("ts"), "t")


def spread_lane(anchors: DataFrame, links: DataFrame) -> DataFrame:
    """What hangs on each query's anchors (query, cui, score) by links (source_cui, cui, weight)."""
    a = anchors.select("query", F.col("cui").alias("source_cui"), F.col("score").alias("s"))
    return a.join(links, "source_cui").groupBy("query", "cui").agg(F.max(F.col("s") * F.col("weight")).alias("score"))


def unite(lanes: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """(query, cui, lanes, in_<lane>..., rank_score): one row a query and concept with its best score in each lane, 0 where
    it is in none, and their weighted sum."""
    weights = weights or LANES
    every = reduce(DataFrame.unionByName, (d.select("query", "cui", F.lit(i).alias("lane"), F.col("score").cast("double").alias("score")) for i, d in enumerate(lanes.values())))
    own = {n: F.col("lane") == i for i, n in enumerate(lanes)}
    best = every.groupBy("query", "cui").agg(*(F.coalesce(F.max(F.when(is_own, F.col("score"))), F.lit(0.0)).alias(f"in_{n}") for n, is_own in own.items()), *(F.max(is_own).alias(f"has_{n}") for n, is_own in own.items()))
    best = best.withColumn("lanes", F.concat_ws("+", *(F.when(F.col(f"has_{n}"), F.lit(n)) for n in sorted(own)))).drop(*(f"has_{n}" for n in own))
    total = reduce(Column.__add__, (F.col(f"in_{n}") * weights[n] for n in lanes))
    return best.withColumn("rank_score", F.round(total, 6))


def page(hits: DataFrame, k: int, number: int = 1, mode: str = "balanced") -> DataFrame:
    """Hits of at least the mode's score in order, the ``number``-th page of ``k``, with their places from 1. Where no
    hit of a query is good enough its best one stays."""
    w = Window.partitionBy("query").orderBy(F.desc("rank_score"), "cui")
    placed = hits.withColumn("place", F.row_number().over(w))
    kept = placed.where((F.col("place") <= number * k) & (F.col("place") > (number - 1) * k))
    return kept.where((F.col("rank_score") >= MODES[mode]) | (F.col("place") == 1))


def hydrate(hits: DataFrame, labels: DataFrame, evidence: DataFrame) -> DataFrame:
    """The page's hits with label (of labels: cui, label), evidence_count (of evidence: cui) and a confidence level."""
    wanted = hits.select("cui").distinct()
    lab = labels.where("label is not null").join(wanted, "cui", "left_semi").groupBy("cui").agg(F.min("label").alias("label"))
    count = evidence.join(wanted, "cui", "left_semi").groupBy("cui").agg(F.count("*").alias("evidence_count"))
    out = hits.join(lab, "cui", "left").join(count, "cui", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    level = F.when((F.col("rank_score") >= 0.9) & (F.col("evidence_count") > 0), "high").when(F.col("rank_score") >= 0.6, "medium").otherwise("low")
    return out.withColumn("level", level)


def answer(hits: DataFrame) -> DataFrame:
    """One row a query with its hits in order, as a service would give them."""
    hit = F.struct("place", "cui", "label", "rank_score", "level", "lanes")
    return hits.groupBy("query").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(hit)).alias("hits"))


def document_hits(chunk_hits: DataFrame) -> DataFrame:
    """Hits of chunks (doc, chunk, section, cui, score) united by document: best score, first chunk, number of chunks and
    the sections they come from."""
    return chunk_hits.groupBy("doc", "cui").agg(F.max("score").alias("score"), F.min("chunk").alias("first_chunk"), F.countDistinct("chunk").alias("n_chunks"), F.array_join(F.sort_array(F.collect_set("section")), ",").alias("sections"))
