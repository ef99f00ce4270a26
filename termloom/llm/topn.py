"""The N best rows of every group, however large a group is.

Every partition's own N-th best row of a group bounds the group's N-th best row overall. The tightest bound of
each large group is brought to all rows, which drops nearly all of the group before anything is shuffled; the
survivors are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

#: Rows a task holds at a time while it looks for bounds.
CHUNK = 1 << 20
#: Bounds are kept for at most so many groups, those with the most rows; all other groups are small beside a
#: partition and are ranked without a bound, so the result does not depend on this.
MAX_BOUNDS = 100_000


def top_n(df: DataFrame, group: str, score: Column, ties: list[str], n: int) -> DataFrame:
    """The ``n`` rows of lowest ``score`` in each ``group``, with their place as ``top_rank`` (from 1).

    Scores are compared in their own type. Ties go to the lower values of ``ties``, in turn; null ties come first. Rows whose score is null or NaN never
    qualify; rows without a group form no group. Repeated rows count each. Give a negated score for the highest
    first. Columns of ``df`` are kept; one named ``top_rank`` or starting with ``__`` would be replaced.
    """
    kind = df.select(score.alias("s")).schema["s"].dataType
    real = isinstance(kind, (FloatType, DoubleType))
    scored = df.withColumn("__score", score + F.lit(0.0).cast(kind) if real else score).where(F.col("__score").isNotNull() & F.col(f"`{group}`").isNotNull())
    scored = scored.where(~F.isnan("__score")) if real else scored
    place = F.row_number().over(Window.partitionBy(F.col(f"`{group}`")).orderBy("__score", *(F.col(f"`{c}`") for c in ties)))
    if not isinstance(kind, NumericType):  # no arithmetic, no bound
        return scored.withColumn("top_rank", place).where(F.col("top_rank") <= n).drop("__score")
    # a double keeps the order of any number but may let two numbers fall together, so it serves as a bound only
    rough = F.col("__score").cast("double")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held)
            held.clear()
            codes = t.column("g").combine_chunks().dictionary_encode()
            g = codes.indices.to_numpy(zero_copy_only=False)
            s = t.column("s").to_numpy()
            counts = np.bincount(g, minlength=len(codes.dictionary))
            big = np.flatnonzero(counts >= max(n, 32))
            if not len(big):
                return None
            rows = np.flatnonzero(np.isin(g, big))
            rows = rows[np.lexsort((s[rows], g[rows]))]
            starts = np.flatnonzero(np.r_[True, g[rows][1:] != g[rows][:-1]])
            nth = rows[starts + n - 1]
            return pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(g[nth])).cast(pa.string()), pa.array(s[nth]), pa.array(counts[g[nth]].astype("i8"))], ["g", "s", "c"])

        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                if (out := flush()) is not None:
                    yield out
                size = 0
        if held and (out := flush()) is not None:
            yield out

    found = scored.select(F.col(f"`{group}`").cast("string").alias("g"), rough.alias("s")).mapInArrow(local, "g string, s double, c long")
    best = found.groupBy("g").agg(F.min("s").alias("__bound"), F.sum("c").alias("c")).orderBy(F.desc("c"), "g").limit(MAX_BOUNDS)
    bounds = best.select(F.col("g").alias("__g"), "__bound")
    kept = scored.join(F.broadcast(bounds), F.col(f"`{group}`").cast("string") == F.col("__g"), "left").where(F.col("__bound").isNull() | (rough <= F.col("__bound")))
    return kept.withColumn("top_rank", place).where(F.col("top_rank") <= n).drop("__score", "__g", "__bound")
