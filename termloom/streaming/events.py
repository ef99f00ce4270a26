"""Windowed aggregates of event streams. Every function takes a streaming or a static DataFrame (event_id, ts, user_id,
event_type, value) and declares its watermark, which a static one ignores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Streams need a time with a zone: one without is taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without redeliveries of an id."""
    marked = _timed(events).withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else marked.dropDuplicates(["event_id"])


def upsert_into(path: str, key: str, order: str):
    """A ``foreachBatch`` function that keeps the latest row of each key in a parquet table: every batch writes a new
    version beside the old one and then points the file ``current`` to it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/current")
        fs = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        rows = batch
        if fs.exists(pointer):
            version = spark.read.text(f"{path}/current").first()[0]
            if version == f"v{batch_id}":
                return  # delivered again after a restart
            rows = spark.read.schema(batch.schema).parquet(f"{path}/{version}").unionByName(batch)
        whole = F.struct(*batch.columns)
        rows.groupBy(key).agg(F.max_by(whole, order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/v{batch_id}")
        # written whole beside the old pointer and put in its place by one rename, so a crash leaves one or the other
        beside = jvm.org.apache.hadoop.fs.Path(f"{path}/.current-{batch_id}")
        out = fs.create(beside, True)
        out.writeBytes(f"v{batch_id}\n")
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(pointer), over)

    return write
