"""Mix sources to target shares of all tokens, in blocks of fixed length.

The documents of each source are laid end to end and cut into blocks of ``BLOCK`` tokens. The number of blocks
each source gives follows from the targets; each output shard draws its counts from them at random (multinomial
counts given their sums, so the shares are met), slot by slot a pseudorandom permutation of the source's
blocks names the block, and blocks are joined by their index. No list of blocks is ever brought to one place.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.operators.cumulative import running_total
from termloom.session import cut

BLOCK = 128
#: Blocks in an output shard.
SHARD = 4096
#: Length from which a text is encoded in stretches, which gives the same tokens.
LONG_TEXT = 100_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split of a text into the stretches within which the vocabulary's pairs are merged; part of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _encoder(path: str):
    import base64
    import sys
    import types

    import tiktoken

    # one encoder a worker process, whatever number of tasks it runs
    held = sys.modules.setdefault("_termloom_encoders", types.ModuleType("_termloom_encoders")).__dict__
    if path not in held:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[path]


#: Where one stretch surely ends and the next begins: a single blank between a sign that is none and a letter.
_SURE_CUT = re.compile(r"(?<=\S)(?= [^\W\d_])")


def stretches(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """The text in parts of about ``size`` characters whose tokens are together those of the whole."""
    at = 0
    while len(text) - at > size:
        cut_at = _SURE_CUT.search(text, at + size)
        if cut_at is None:
            break
        yield text[at : cut_at.start()]
        at = cut_at.start()
    yield text[at:]


def token_counts(text, path: str = VOCABULARY):
    """Number of tokens of each text under a public vocabulary file (null for null). The file is sent to the workers
    with the job where a session is running, so it need only exist at the driver."""
    session = SparkSession.getActiveSession()
    if session is not None and os.path.exists(path) and not session.sparkContext.master.startswith("local"):
        session.sparkContext.addFile(path)

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        sent = SparkFiles.get(os.path.basename(path))
        enc = _encoder(sent if os.path.exists(sent) else path)
        return s.map(lambda t: sum(len(enc.encode_ordinary(p)) for p in stretches(t)), na_action="ignore").astype("Int64")

    return count(text)


def _permute(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 applied to ``index`` (Feistel rounds, walked until inside the range)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = np.frombuffer(hashlib.sha256(key.encode()).digest(), "<u8")

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in rounds:
            m = (right + r) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ m >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (m >> np.uint64(17) & mask)
        return left << np.uint64(half) | right

    x = once(index.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _hypergeometric(good: int, rest: int, take: int, rng: np.random.Generator) -> int:
    """How many good ones a uniform choice of ``take`` out of ``good + rest`` holds, exact at any size: every item is
    chosen independently, and as many as are then too many (too few) are put back (added) uniformly, which is a
    smaller choice of the same kind."""
    if not good or not take:
        return 0
    if not rest or take == good + rest:
        return min(good, take)
    if take <= 8:
        found = 0
        for i in range(take):
            found += int(rng.integers(good + rest - i)) < good - found
        return found
    p = take / (good + rest)
    a, b = int(rng.binomial(good, p)), int(rng.binomial(rest, p))
    if a + b > take:
        return a - _hypergeometric(a, b, a + b - take, rng)
    return a + _hypergeometric(good - a, rest - b, take - a - b, rng)


def _draw(total: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``take`` draws without replacement fall to each source that has ``total`` slots left."""
    out, left, need = np.zeros(len(total), np.int64), int(total.sum()), int(take)
    for i, good in enumerate(map(int, total)):
        out[i] = x = _hypergeometric(good, left - good, need, rng)
        left, need = left - good, need - x
    return out


def shard_counts(total: np.ndarray, shard: int, shards: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(draws of earlier shards, draws of this shard) by source: halve the shards down to this one; every shard
    repeats the same draws on its way, so nothing has to be handed round."""
    lo, hi, here, before = 0, shards, total.astype(np.int64), np.zeros(len(total), np.int64)
    slots = int(total.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _draw(here, min(mid * size, slots) - lo * size, np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            hi, here = mid, left
        else:
            before, here, lo = before + left, here - left, mid
    return before, here


def mix(docs: DataFrame, doc_id: str, source: str, tokens: str, targets: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 11, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(draws, shares).

    draws: ``shard``, ``slot``, ``source``, ``round``, ``block``, ``doc_id``, ``from_token``, ``to_token``: the
    stretch of a document in each drawn block; a block comes at most once a round, and there are at most
    ``max_repeats`` rounds. shares: per source of either side the tokens available and drawn, ``target_share``,
    ``actual_share`` and ``max_repeats``. ``targets`` has source, target_share and max_repeats.

    The mix is as large as the scarcest source allows while all sources with documents keep their targets (scaled
    to sum to 1 if some targets have no documents). With ``total_tokens`` it is that large: a source that cannot give
    its share within its repeats falls short, and ``actual_share`` says by how much. Documents of sources without a target, without a source, or
    without tokens are not drawn. Source names are compared as written.
    """
    goal = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.toLocalIterator() if r.source is not None and r.target_share and r.max_repeats}
    sized = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{tokens}`").cast("long").alias("n")).where("n > 0")
    sized = cut(sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    have = {r.source: int(r.n) for r in sized.where(F.col("source").isin(list(goal))).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names = sorted(s for s in have if goal[s][0] > 0 and goal[s][1] > 0)
    blocks = np.array([-(-have[s] // block) for s in names], np.int64)
    share = np.array([goal[s][0] for s in names]) / max(sum(goal[s][0] for s in names), 1e-300)
    tokens_all = min((have[s] * goal[s][1] / w for s, w in zip(names, share, strict=True)), default=0.0)
    tokens_all = tokens_all if total_tokens is None else float(total_tokens)
    # a source's blocks hold have/blocks tokens on average; as many as its share needs, at most its rounds allow
    take = np.array([min(int(b) * goal[s][1], round(tokens_all * w * int(b) / have[s])) for s, w, b in zip(names, share, blocks, strict=True)], np.int64)
    spark = docs.sparkSession
    shards = -(-int(take.sum()) // shard)

    def slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"]:
                before, here = shard_counts(take, int(i), shards, shard, seed)
                which = np.repeat(np.arange(len(names)), here)
                draw = np.concatenate([np.arange(a, a + n) for a, n in zip(before, here, strict=True)])
                turn, at = draw // blocks[which], draw % blocks[which]
                picked = np.empty(len(draw), np.int64)
                for s in np.unique(which):
                    for t in np.unique(turn[which == s]):
                        rows = (which == s) & (turn == t)
                        picked[rows] = _permute(at[rows], int(blocks[s]), f"{seed}/{names[s]}/{t}")
                order = np.random.default_rng([seed, 1, int(i)]).permutation(len(draw))
                yield pd.DataFrame({"shard": np.int64(i), "slot": i * shard + order, "source": np.array(names, object)[which], "round": turn.astype(np.int32), "block": picked})

    index = spark.range(shards).repartition(max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(slots_of, "shard long, slot long, source string, round int, block long")
    laid = running_total(sized.where(F.col("source").isin(names)), ["source", "h", "doc_id"], F.col("n"), "at")
    start = laid.groupBy("source").agg(F.min("at").alias("zero"))
    laid = laid.join(F.broadcast(start), "source").withColumn("at", F.col("at") - F.col("zero"))  # one row a target source
    laid = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n") - 1) / block))))
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("at"))
    hi = F.least(F.col("n"), (F.col("block") + 1) * block - F.col("at"))
    pieces = laid.select("source", "block", "doc_id", lo.alias("from_token"), hi.alias("to_token"))
    draws = index.join(pieces, ["source", "block"]).select("shard", "slot", "source", "round", "block", F.col("doc_id").alias(doc_id), "from_token", "to_token")
    got = draws.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("drawn"))
    known = sized.groupBy("source").agg(F.sum("n").alias("available"))
    goals = spark.createDataFrame([(s, *g) for s, g in goal.items()], "source string, target_share double, max_repeats int")
    per = known.where("source is not null").join(goals, "source", "full").join(got, "source", "left")
    drawn = F.coalesce("drawn", F.lit(0))
    total = F.sum("drawn").over(Window.partitionBy(F.lit(0)))  # one row a source
    shares = per.select("source", F.coalesce("available", F.lit(0)).alias("available_tokens"), drawn.alias("drawn_tokens"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce(drawn / total, F.lit(0.0)).alias("actual_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    return draws, shares
