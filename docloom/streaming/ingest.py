"""Structured Streaming: documents that arrive as files replace their rows in the store; windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.store import Store


def replace_stream(chunks: DataFrame, store: Store, name: str, checkpoint: str) -> StreamingQuery:
    """A streaming chunk table into the store: each micro-batch replaces the documents it holds, so replaying one changes nothing."""
    return (
        chunks.writeStream.foreachBatch(lambda batch, _: store.replace_documents(name, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, <kind>, events, total) per tumbling window; rows later than ``late`` behind the newest are left out of closed windows."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    w = F.window(F.col(at), width)
    x = events.withWatermark(at, late) if events.isStreaming else events
    return x.groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), kind, "events", "total")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Run a stream over what is there now; in complete mode the table at ``path`` holds the last result."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A parquet folder or file as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)
