"""Streams: index new files as they come, drop repeated rows, count events by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import index


def ingest(spark: SparkSession, folder: str, out: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Append the postings and lengths of unseen Parquet files; the checkpoint remembers which were seen."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # A repeated batch overwrites its own folder, so each is counted once.
        index.postings(batch).write.mode("overwrite").parquet(f"{out}/postings/batch={batch_id}")
        index.doc_stats(batch).write.mode("overwrite").parquet(f"{out}/doc_stats/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()


def unique(events: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windows(events: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """``start, event_type, n, total`` by tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_windows(events: DataFrame, gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """``user_id, start, n`` of runs of a user's events with gaps below ``gap``."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", delay).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def to_folder(stream: DataFrame, out: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end and read what it wrote to ``out``.

    Each micro-batch has a folder of its own, which a repeated batch overwrites;
    in complete mode the last one holds the result. A stream of no batch gives no rows.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/{'last' if mode == 'complete' else f'batch-{batch_id}'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
