"""Incremental processing with Structured Streaming (Y-1, Y-3, Y-4; the event-time operators go beyond the reference)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docforge.functions.work import written


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New parquet files of a folder as a stream; the bound on files a trigger is its back-pressure (Y-1)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def appended(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """What is there now, appended to an output that can be resumed (Y-4)."""
    return stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: list[str], time: str, delay: str = "7 days") -> DataFrame:
    """Redelivered rows dropped as long as they come within the delay; state older than the watermark is let go."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Rows by window and key; late rows count until the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def requeued(stream: DataFrame, process, good: str, bad: str, checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Each micro-batch through ``process`` (which adds ``error``); failed rows are tried again up to ``attempts`` times
    within the batch, then written to the dead letters (Y-3). The answers of a try are written before they are split, so a
    row is processed once a try; a batch that is run again replaces all that an earlier run of it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        todo, parts = batch, []
        for k in range(attempts):
            done = written(process(todo), "try")
            parts.append(done.where("error is null"))
            left = done.where("error is not null")
            todo = left.select(*batch.columns)
            if not left.limit(1).count():
                break
        reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{good}/batch={number}")
        left.write.mode("overwrite").json(f"{bad}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
