"""Monitoring samples by time windows, in batch and as a stream, and exactly-once appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def windowed(samples: DataFrame, ts: str, phase: str, memory: str, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """(window_start, phase, samples, peak_memory, avg_memory); with lateness the stream's watermark is set."""
    s = samples.withColumn(ts, F.col(ts).cast("timestamp"))
    s = s.withWatermark(ts, lateness) if lateness else s
    out = s.groupBy(F.window(ts, width), phase).agg(F.count("*").alias("samples"), F.max(memory).alias("peak_memory"), F.avg(memory).alias("avg_memory"))
    return out.select(F.col("window.start").alias("window_start"), phase, "samples", "peak_memory", "avg_memory")


def sessions(samples: DataFrame, ts: str, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(key, start, end, samples): runs of samples with no gap longer than `gap`."""
    s = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return s.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("samples")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "samples")


def append_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataStreamWriter:
    """Append rows whose keys the table at path lacks; a batch that runs again adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def timed(name: str, action: Callable, clock: Callable[[], float], memory: Callable[[], float] | None = None) -> tuple[object, dict[str, float]]:
    """The action's result and {name_duration: seconds}, with memory also {name_memory_delta}."""
    began, held = clock(), memory() if memory else 0.0
    result = action()
    said = {f"{name}_duration": clock() - began}
    return result, said | ({f"{name}_memory_delta": memory() - held} if memory else {})
