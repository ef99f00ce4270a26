"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A parquet table of a dataset directory, narrowed to ``columns`` when any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``. Only on a single machine, as in tests, is
    there a temporary folder in its place; on a cluster without one nothing is run, since executors could not read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="termloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors.

    A checkpointed DataFrame keeps the planner's size estimate and constraints. Over repeated joins the estimate
    is multiplied to numbers of millions of digits, so the rows are handed on without either; AQE then goes by
    the sizes it measures. Where the session has no such handle the checkpoint is given as it is. Spark removes
    checkpoints that are no longer used if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    if not hasattr(kept, "_jdf"):
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)


def cut_counting(df: DataFrame, count: Column) -> tuple[DataFrame, int]:
    """``cut(df)`` and how many of its rows meet ``count``, told by the same job."""
    seen = Observation()
    kept = cut(df.observe(seen, F.count_if(count).alias("n")))
    return kept, int(seen.get.get("n") or 0)


def as_integer(sql: dict[str, str], columns: dict[str, str]) -> dict[str, str]:
    """The SQL of some queries with one column each as a 4-byte integer, as Spark has places and sizes."""
    return sql | {name: f"select * replace (cast({c} as integer) as {c}) from ({sql[name]})" for name, c in columns.items()}
