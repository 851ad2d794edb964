"""Intake of request lines as a stream: files arrive in a folder, each batch is parsed and stored by key, and a restart goes on from the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import parse_line


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the parsed lines of new text files; a line's key is the hash of its file and text."""
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    return lines.select(F.sha2(F.concat_ws("\n", "file", "value"), 256).alias("line_key"), "file", parse_line(F.col("value")).alias("p")).select("line_key", "file", "p.*")


def store(stream: DataFrame, out: str, checkpoint: str):
    """Take all that has arrived.  A batch is written to its own folder, so that a repeated one replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(["line_key"]).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events and their value by type and window, late ones dropped after the watermark (an addition of ours)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def progress(query) -> dict:
    """Where a running stream stands, for whoever polls it: batch, rows of the last batch, and whether more is waiting or it has failed."""
    last = query.lastProgress or {}
    error = query.exception()
    return {"batch": last.get("batchId", -1), "rows": last.get("numInputRows", 0), "active": query.isActive, "waiting": query.status.get("isDataAvailable", False), "error": str(error) if error else ""}


def fresh(batch: DataFrame, done: DataFrame, key: str = "content_hash") -> DataFrame:
    """Inputs of a batch whose content wasn't handled before; of equal ones in the batch one."""
    return batch.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")
