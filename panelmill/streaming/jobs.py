"""Structured Streaming twins of the scheduled jobs.

Every job reads files with an explicit schema, keeps its offsets in a checkpoint below the shared folder
and writes a file table; nothing is gathered on the driver. `availableNow` drains what is there; a service
passes a processing-time trigger instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelmill.operators.panel import dedupe_keep_last
from panelmill.session import shared_folder

# The news schedule.
NEWS_EVERY = "4 hours"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def count_files(spark: SparkSession, pattern: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ())


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", every: str | None = None):
    """Write the stream to Parquet; drain and stop, or run on a processing-time trigger."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain an append stream into a fresh table and read it back."""
    spark = stream.sparkSession
    target = shared_folder(spark, name)
    drain(stream, f"{target}/data", f"{target}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{target}/data")


# ------------------------------------------------------------------------------ jobs


def stream_dedupe(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First row per key inside the watermark; the state is bounded by it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_daily(stream: DataFrame, ts: str, value: str, delay: str, *keys: str) -> DataFrame:
    """Tumbling days: mean and count, emitted once the watermark has passed the day."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), *keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return w.select(F.to_date("window.start").alias("dt"), *keys, "mean", "n")


def stream_digest(stream: DataFrame, ts: str, value: str, delay: str, days: int = 7) -> DataFrame:
    """Look-back digest: windows of `days` days that slide by one day."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{days} days", "1 day")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return w.select(F.to_date("window.start").alias("first_day"), "mean", "n")


def stream_enrich(stream: DataFrame, dimension: DataFrame, key: str, default: dict[str, str]) -> DataFrame:
    """Stream-static lookup; the join strategy follows the size of the dimension."""
    return stream.join(dimension, key, "left").fillna(default)


def write_upserts(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of the upsert log: one folder per batch, so a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    return write


def read_upserts(spark: SparkSession, root: str, keys: list[str], sequence: str) -> DataFrame:
    """Newest record per key of the log: later batch first, then the larger sequence."""
    log = spark.read.parquet(root)
    ordered = log.withColumn("_order", F.struct(F.col("batch_id").cast("long"), F.col(sequence)))
    return dedupe_keep_last(ordered, keys, "_order").drop("_order", "batch_id")


def stream_upsert(stream: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    spark = stream.sparkSession
    target = shared_folder(spark, "upsert")
    drain_batches(stream, write_upserts(f"{target}/log"), f"{target}/checkpoint")
    return read_upserts(spark, f"{target}/log", keys, sequence)


def stream_freshness(stream: DataFrame, ts: str, *keys: str) -> DataFrame:
    """Running newest stamp and count per key; the sink keeps the last complete state."""
    spark = stream.sparkSession
    target = shared_folder(spark, "fresh")
    running = stream.groupBy(*keys).agg(F.max(ts).alias("newest"), F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    drain_batches(running, write, f"{target}/checkpoint", "update")
    log = spark.read.parquet(target + "/batch_id=*")
    # counts and stamps only grow, so the largest is the newest state
    return log.groupBy(*keys).agg(F.max("newest").alias("newest"), F.max("n").alias("n"))


def late_catch_up(stream: DataFrame, ts: str, delay: str, *keys: str) -> DataFrame:
    """Daily counts that accept rows up to `delay` late and drop older ones; update mode, last state per day."""
    spark = stream.sparkSession
    target = shared_folder(spark, "late")
    daily = stream.withWatermark(ts, delay).groupBy(F.window(ts, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"))
    daily = daily.select(F.to_date("window.start").alias("dt"), *keys, "n")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    drain_batches(daily, write, f"{target}/checkpoint", "update")
    return spark.read.parquet(target + "/batch_id=*").groupBy("dt", *keys).agg(F.max("n").alias("n"))


class HighWater(StatefulProcessor):
    """Emits rows later than the key's mark at the start of the batch, then raises the mark."""

    def __init__(self, order: str, columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.mark.get()  # none without a mark; one request to the store, where asking first makes two
        old = pd.Timestamp(found[0]) if found is not None else None
        newest = old
        for chunk in rows:
            if old is not None:
                chunk = chunk[chunk[self.order] > old]
            if len(chunk):
                top = chunk[self.order].max()
                newest = top if newest is None or top > newest else newest
                yield chunk[self.columns]
        if newest is not None and newest is not old:
            self.mark.update((newest.to_pydatetime(),))

    def close(self) -> None:
        pass


def stateful_high_water(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Rows later than the newest one seen per key, with one timestamp of state per key.

    Arbitrary state needs the RocksDB store, which also keeps a large key space off the heap.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=HighWater(order, stream.columns), outputStructType=stream.schema, outputMode="Append", timeMode="None"
    )


def load_or_resume(spark: SparkSession, source: str, schema, target: str, fmt: str = "parquet") -> str:
    """One entry point for both loads: an empty target takes everything, a filled one what is new.

    The checkpoint is the memory of what was read, so both modes are the same drain.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/checkpoint/commits")
    resumed = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    mode = "incremental" if resumed else "full"
    stream = stream_files(spark, source, schema, fmt).withColumn("load_mode", F.lit(mode))
    drain(stream, f"{target}/data", f"{target}/checkpoint")
    return mode
