"""Structured Streaming over files: continuous loads, windows with watermarks, deduplication, joins and refreshed views.

Every pipeline reads a folder of Parquet files as they arrive and, with the ``availableNow`` trigger, ends when all are
read; then its sink holds what the batch query over the same files would give, which is how it is tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.files import FORMATS
from ..sources.files import options as files_options
from ..sources.scratch import folder


def source(spark: SparkSession, path: str, schema=None, most_files: int = 1) -> DataFrame:
    """A stream of the Parquet files below ``path``, a few for each trigger."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", most_files).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of what is available and read the sink; in complete mode that is the last batch's state."""
    if mode not in ("append", "complete"):
        raise ValueError("an update's batch holds only the keys that changed, so the last one is no state")
    spark = stream.sparkSession
    out, marks = folder(spark, "sink"), folder(spark, "marks")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    # each batch has its own folder, so that a batch that runs twice replaces itself
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n:09d}")).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    made = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    last = made.agg(F.max("batch")).first()[0]
    return made.where(F.col("batch") == (-1 if last is None else last)).drop("batch")


def routine_load(stream: DataFrame, target: str, marks: str, name: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, **trigger) -> StreamingQuery:
    """A named continuous load into a Parquet table; ``stop()`` pauses it and a new start with the same marks resumes."""
    return transform(stream).writeStream.queryName(name).format("parquet").option("path", target).option("checkpointLocation", marks).trigger(**(trigger or {"availableNow": True})).start()


def tumbling(stream: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts per window and keys; windows close when the watermark passes them."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", width), *keys).count().select(F.col("window.start").cast("timestamp_ntz").alias("start"), *keys, F.col("count").alias("n"))


def sliding(stream: DataFrame, time: str, width: str, step: str, late: str) -> DataFrame:
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", width, step)).count().select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("count").alias("n"))


def sessions(stream: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.session_window("__t", gap), key).count().select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("count").alias("n"))


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """First rows by keys, remembered for the watermark's delay."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.dropDuplicatesWithinWatermark(keys).drop("__t")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Pairs of two streams with the same key whose right row follows within an interval."""
    a = left.withColumn("__a", F.col(left_time).cast("timestamp")).withWatermark("__a", late).alias("a")
    b = right.withColumn("__b", F.col(right_time).cast("timestamp")).withWatermark("__b", late).alias("b")
    near = F.expr(f"a.{key} = b.{key} AND b.__b >= a.__a AND b.__b <= a.__a + INTERVAL {within}")
    return a.join(b, near, "inner")


def external(spark: SparkSession, location: str, kind: str, schema: str, **options) -> DataFrame:
    """An external stream: a location of files of a format, read as they come."""
    return spark.readStream.format(FORMATS.get(kind.upper(), kind.lower())).options(**files_options(**options)).schema(schema).load(location)


def processors(spark: SparkSession) -> list[str]:
    """The names of the stream processors that run."""
    return sorted(query.name for query in spark.streams.active if query.name)


def stop_processor(spark: SparkSession, name: str) -> None:
    for query in spark.streams.active:
        if query.name == name:
            query.stop()
            return
    raise ValueError(f"no stream processor is named {name}")


def refreshed(stream: DataFrame, view: Callable[[DataFrame], DataFrame], path: str, marks: str, lag: str | None = None) -> StreamingQuery:
    """A materialised view that every batch of changes recomputes by merging sums: ``view`` aggregates a batch.

    ``lag``: how far it may be behind (a dynamic table); without one it ends when all that is available is read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        view(batch).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    trigger = {"processingTime": lag} if lag else {"availableNow": True}
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", marks).trigger(**trigger).start()
