"""The run log as a stream: exactly-once ingestion of calls, and event-time summaries with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def call_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    """A folder of parquet files as a stream. A table that is a single file is streamed from its folder, by its name."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if single:
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def distinct_calls(calls: DataFrame, key: list[str], event_time: str, late: str = "30 days") -> DataFrame:
    """Each call once, however often it was delivered within the lateness; the watermark bounds the state."""
    timed = calls.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)


def windowed_latency(calls: DataFrame, event_time: str, value: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Calls, sum and greatest value per tumbling window of event time; NaN counts as missing."""
    v = F.when(~F.isnan(value), F.col(value))
    timed = calls.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    return timed.groupBy(F.window(event_time, window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.count(v).alias("n_values"), F.sum(v).alias("total"), F.max(v).alias("most")
    )


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop. Append writes files with Spark's exactly-once file sink; complete rewrites the target
    at each batch, into a folder of its own, so that a repeated batch replaces what it wrote before."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{target}/batch={i}")).start()
    query.awaitTermination()


def latest_batch(spark: SparkSession, target: str) -> DataFrame:
    """The rows that the last batch of a complete-mode run wrote."""
    all_batches = spark.read.parquet(target)
    last = all_batches.agg(F.max("batch").alias("batch"))
    return all_batches.join(F.broadcast(last), "batch").drop("batch")  # last: one row
