"""Incremental work as Structured Streaming: running counts, and resumable asking with keyed upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, form: str = "parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).format(form).load(path)


def running_counts(stream: DataFrame, keys: list[str], name: str, checkpoint: str) -> StreamingQuery:
    """Counts by keys over all that has come, in a table in memory, until the source is drained."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], size: str, late: str, path: str, checkpoint: str) -> StreamingQuery:
    """Counts by event-time window and keys, written once a window can get no more late rows."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    flat = counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")
    return flat.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(stream: DataFrame, keys: list[str], time: str | None = None, expiry: str | None = None) -> DataFrame:
    """The rows of a stream whose key has not come before.

    Keys are state of the stream: a batch looks up its own keys only, whatever came before it. With an
    event time, a key is forgotten once the watermark has passed its row by ``expiry``, and may come
    again; rows later than that are dropped. Without one, every key is kept.
    """
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, expiry).dropDuplicatesWithinWatermark(keys)


def resumable(stream: DataFrame, work: Callable[[DataFrame], DataFrame], keys: list[str], path: str, checkpoint: str, time: str | None = None, expiry: str | None = None) -> StreamingQuery:
    """Work on the rows of each micro-batch whose key is new, so that results are kept once for each key, also when a batch is run again.

    ``keys`` are columns of the stream and of the results. A batch's results replace its own folder, and
    a repeated batch finds the state as it was before it, so it leaves no second copy. Earlier results
    are never read: the work of a batch does not grow with them. Sessions of ``session.session`` keep
    the state in RocksDB.
    """

    def sink(batch: DataFrame, number: int) -> None:
        work(batch).dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    new = unseen(stream, keys, time, expiry)
    return new.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
