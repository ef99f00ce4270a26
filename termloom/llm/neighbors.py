"""The k most similar vectors of every vector, over shifted Hilbert curves.

Unit vectors are projected to a few dimensions by several random rotations, shifted, and put in order along a
Hilbert curve of each projection. In the dense order every block of rows, with a margin from its neighbours, is
scored exactly; the best of all curves are merged and ranked. Blocks are cut by position, so they are equally
large however the vectors are spread, and the work grows in proportion to the rows.

Vectors of one direction would fill whole blocks, so only one of each direction is put on the curves. The others
are brought in afterwards, exactly: of any direction only the k + 1 smallest ids can be among a row's best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.cumulative import running_total
from termloom.session import cut

CURVES = 8
PROJECTED = 8
BITS = 7
#: Rows of a window; an eighth more belongs to it on either side.
BLOCK = 512
#: Rows from which centre and spread of the projections are fitted (those of smallest id hash).
FIT_ROWS = 20_000


def usable(df: DataFrame, id_column: str, vector: str, dims: int, same: str | None = None) -> DataFrame:
    """(row_id, v) of the usable records: exactly ``dims`` finite numbers, not all zero. Of records with one value
    of ``same`` only that with the smallest id takes part; where it is null every record stands for itself."""
    v = F.col(f"`{vector}`")
    sane = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = F.coalesce(F.concat(F.lit("d"), F.col(f"`{same}`").cast("string")), F.concat(F.lit("r"), F.col(f"`{id_column}`").cast("string"))) if same else F.col(f"`{id_column}`").cast("string")
    rows = df.where(F.coalesce(sane, F.lit(False)) & F.col(f"`{id_column}`").isNotNull()).select(own.alias("own"), F.col(f"`{id_column}`").cast("long").alias("row_id"), v.cast("array<float>").alias("v"))
    return rows.groupBy("own").agg(F.min("row_id").alias("row_id"), F.min_by("v", "row_id").alias("v")).drop("own")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of small non-negative integers (Skilling's transposed form)."""
    x = cells.T.astype(np.uint32)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(n):
            on = (x[i] & np.uint32(q)) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint32(q)) != 0, t ^ np.uint32(q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> np.uint32(b) & np.uint32(1)).astype(np.int64)
    return key


def _unit(v: pd.Series) -> np.ndarray:
    m = np.stack(v.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _direction(v: Column) -> list[Column]:
    """A 128-bit digest of a vector's direction. Quotients of 32-bit floats that differ at all differ in 64 bits, so
    the numbers divided by the largest agree exactly where the directions do."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scaled = F.transform(v, lambda x: x.cast("double") / top + F.lit(0.0))  # -0 becomes 0
    return [F.xxhash64(F.lit(i), scaled).alias(f"d{i}") for i in (1, 2)]


def nearest(vectors: DataFrame, k: int = 5, curves: int = CURVES, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(row_id, neighbor, score, rank) of the ``k`` rows of highest cosine similarity to each row of ``vectors``
    (row_id unique, v), itself left out; ties go to the smaller id. Fewer than ``k`` come out only where there
    are no more rows. An empty table gives no rows.

    A row is scored against ``curves`` windows of ``block`` rows and an eighth on either side. Both buy recall: more
    curves in shuffled vectors, larger blocks in arithmetic alone, which large collections should take first."""
    rows = cut(vectors.select("row_id", "v", *_direction(F.col("v"))))
    spark = rows.sparkSession
    place = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("row_id"))
    groups = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("d1", "d2").agg(F.min("row_id").alias("row_id"), F.min_by("v", "row_id").alias("v"), F.sort_array(F.collect_list("row_id")).alias("ids"))
    groups = cut(groups)
    vectors = groups.select("row_id", "v")
    fit = vectors.orderBy(F.xxhash64("row_id"), "row_id").limit(FIT_ROWS).toPandas()
    if not len(fit):
        return spark.createDataFrame([], "row_id long, neighbor long, score double, rank int")
    sample = _unit(fit["v"])
    dims = sample.shape[1]
    rng = np.random.default_rng(seed)
    width = min(PROJECTED, dims)
    turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0][:, :width] for _ in range(curves)]
    shifts = [rng.random(width) / 2 for _ in range(curves)]
    ranges = [np.quantile(sample @ t, [0.02, 0.98], axis=0) for t in turns]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                u = _unit(b["v"])
                out = []
                for c, (turn, shift, (lo, hi)) in enumerate(zip(turns, shifts, ranges, strict=True)):
                    at = ((u @ turn - lo) / np.maximum(hi - lo, 1e-9) + shift) / 1.5
                    cells = np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                    out.append(pd.DataFrame({"row_id": b["row_id"], "curve": np.int32(c), "key": hilbert_keys(cells, BITS)}))
                yield pd.concat(out)

    placed = running_total(vectors.mapInPandas(keys, "row_id long, curve int, key long"), ["curve", "key", "row_id"], F.lit(1), "pos")
    own_block = F.floor(F.col("pos") / block)
    near = F.array_distinct(F.array(own_block, F.floor(F.greatest(F.col("pos") - block // 8, F.lit(0)) / block), F.floor((F.col("pos") + block // 8) / block)))
    spread = placed.select("row_id", own_block.alias("own"), near.alias("near")).join(vectors, "row_id").select("row_id", "v", "own", F.explode("near").alias("block"))

    def score(group: pd.DataFrame) -> pd.DataFrame:
        if group["row_id"].duplicated().any():  # a block over the end of a curve may hold a row twice; its own place counts
            group = group.iloc[np.argsort((group["own"] != group["block"]).to_numpy(), kind="stable")].drop_duplicates("row_id")
        core = (group["own"] == group["block"]).to_numpy()
        ids, u = group["row_id"].to_numpy(), _unit(group["v"])
        sims = u[core] @ u.T
        sims[np.arange(core.sum()), np.flatnonzero(core)] = -np.inf
        m = min(k, len(ids) - 1)
        if m < 1:
            return pd.DataFrame({"row_id": pd.Series([], dtype="int64"), "near": pd.Series([], dtype=object)})
        best = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :m] if sims.shape[1] <= 64 else _best(sims, ids, m)
        near = [[{"score": float(s), "neighbor": int(i)} for s, i in zip(sims[r, c], ids[c], strict=True)] for r, c in enumerate(best)]
        return pd.DataFrame({"row_id": ids[core], "near": pd.Series(near, dtype=object)})

    found = spread.groupBy("block").applyInPandas(score, "row_id long, near array<struct<score: double, neighbor: long>>")
    merged = found.groupBy("row_id").agg(F.flatten(F.collect_list("near")).alias("near"))
    # the same pair may differ in its last bits from block to block, so pairs are told apart by id alone
    pairs = merged.select("row_id", F.explode("near").alias("n")).groupBy("row_id", F.col("n.neighbor").alias("neighbor")).agg(F.max("n.score").alias("score"))
    ranked = pairs.groupBy("row_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "neighbor"))), 1, k).alias("best"))
    others = ranked.select("row_id", F.explode("best").alias("b")).select("row_id", F.col("b.neighbor").alias("first"), F.greatest(F.col("b.s"), F.lit(-1.0)).alias("s"))
    near = others.unionByName(groups.select("row_id", F.col("row_id").alias("first"), F.lit(-1.0).alias("s")))
    members = near.join(groups.select(F.col("row_id").alias("first"), "ids"), "first").select("row_id", "s", F.explode("ids").alias("neighbor"))
    # one more than k, since a row is not its own neighbour
    lists = members.groupBy("row_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "neighbor"))), 1, k + 1).alias("best"))
    by_direction = groups.select("d1", "d2", "row_id").join(lists, "row_id").select("d1", "d2", "best")
    own = F.slice(F.filter("best", lambda b: b["neighbor"] != F.col("row_id")), 1, k)
    told = rows.select("row_id", "d1", "d2").join(by_direction, ["d1", "d2"])
    return told.select("row_id", F.posexplode(own).alias("p", "b")).select("row_id", F.col("b.neighbor").alias("neighbor"), (-F.col("b.s")).alias("score"), (F.col("p") + 1).alias("rank"))


def _best(sims: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """The m best columns of each row, all ties at the edge taken into account."""
    edge = -np.partition(-sims, m - 1, axis=1)[:, m - 1 : m]
    out = np.empty((len(sims), m), int)
    for r in range(len(sims)):
        c = np.flatnonzero(sims[r] >= edge[r])
        out[r] = c[np.lexsort((ids[c], -sims[r, c]))[:m]]
    return out
