"""Sinks. Each writes with the executors and returns the number of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from termloom.operators.cumulative import running_total


def jsonl(df: DataFrame, path: str) -> int:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def vectors(df: DataFrame, path: str, dims: int) -> int:
    """Vectors as float32 parquet; a vector of another length ends the job."""
    seen = Observation()
    same = F.when(F.size("vector") == dims, F.col("vector").cast("array<float>")).otherwise(F.raise_error(F.lit(f"a vector has not {dims} numbers")))
    df.withColumn("vector", same).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def bulk_lines(df: DataFrame, path: str, index: str, id_column: str, per_file: int = 5000) -> int:
    """Bulk-load lines of a search engine: an action line and the document for each row, ``per_file`` rows a file."""
    seen = Observation()
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(id_column).alias("_id")).alias("index")))
    lines = df.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*df.columns))).alias("value"))
    lines.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)
    return seen.get["n"]


def compact_vectors(df: DataFrame, path: str, dims: int, block: int = 4096) -> int:
    """Vectors (vector and any other columns) as blocks of a little-endian float32 matrix, their metadata as JSON lines
    with the place in it (pos), and a manifest of rows, dims and block. A vector of another length ends the job."""
    placed = running_total(df.withColumn("__h", F.xxhash64(*df.columns)).withColumn("__m", F.monotonically_increasing_id()), ["__h", "__m"], F.lit(1), "pos").drop("__h", "__m")
    placed = placed.withColumn("vector", F.when(F.size("vector") == dims, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector has not {dims} numbers"))))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(g.sort_values("pos")["vector"].to_numpy()).astype("<f4")
        return pd.DataFrame({"block": [int(g["pos"].iloc[0]) // block], "matrix": [m.tobytes()]})

    placed.select("pos", "vector", F.floor(F.col("pos") / block).alias("b")).groupBy("b").applyInPandas(pack, "block long, matrix binary").write.mode("overwrite").parquet(f"{path}/matrix")
    n = jsonl(placed.drop("vector"), f"{path}/metadata")
    df.sparkSession.createDataFrame([(n, dims, block)], "rows long, dims int, block int").write.mode("overwrite").json(f"{path}/manifest")
    return n
