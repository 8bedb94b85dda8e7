"""Incremental ingest with Structured Streaming: micro-batches, upserts, seen keys, counters, the work queue."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listinglens.sources.snapshots import upsert


def file_stream(spark: SparkSession, path: str, schema, files: int = 1, ts: str | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, so many for each batch; ts is cast to an instant for watermarks."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def ingest_stream(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run the stream over what is there now; sink gets each batch and its number."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(stream: DataFrame, path: str, key: str, order: Sequence[str], checkpoint: str, partition: str | None = None) -> None:
    """Keep the last row of each key over all batches. A batch that is replayed changes nothing; with a partition column a batch rewrites only what it touches."""
    ingest_stream(stream, lambda batch, _: upsert(batch, path, key, order, partition), checkpoint)


def drop_seen(stream: DataFrame, key: str, ts: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key; with a watermark the state is bounded to keys seen within it."""
    if ts and within:
        return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_counters(stream: DataFrame, run: str, event: str) -> DataFrame:
    return stream.groupBy(run, event).count()


def windowed_counters(stream: DataFrame, ts: str, event: str, width: str, late: str) -> DataFrame:
    """Counts by event and window of event time; a row later than `late` is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), event).count()


def advance_queue(queue: DataFrame, results: DataFrame, key: str, order: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(next queue, visited): the first `limit` keys were tried; those without a good result stay in the queue."""
    tried = queue.orderBy(order).limit(limit)
    done = tried.join(results.where("ok").select(key), key, "left_semi")
    return queue.join(done.select(key), key, "left_anti"), done
