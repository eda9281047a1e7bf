"""Job events as a stream, incremental stages, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "job string, seq long, kind string, done long, total long, message string, at timestamp"


def since(events: DataFrame, job: str, seq: int) -> DataFrame:
    """Events of a job after a sequence number, in order: what a reader that reconnects has missed."""
    return events.where((F.col("job") == job) & (F.col("seq") > seq)).orderBy("seq")


def state(events: DataFrame) -> DataFrame:
    """(job, status, done, total, message, last_seq): each job's events folded into its present state."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    status = F.max_by("kind", F.when(F.col("kind").isin("started", "finished", "failed", "cancelled"), F.col("seq")))
    return events.groupBy("job").agg(status.alias("status"), last("done").alias("done"), last("total").alias("total"), last("message").alias("message"), F.max("seq").alias("last_seq"))


def remaining(events: DataFrame, concurrency: int = 1) -> DataFrame:
    """(job, seconds): median seconds between finished items, times what is pending, by the number at once."""
    w = Window.partitionBy("job").orderBy("seq")
    steps = events.where("done IS NOT NULL").withColumn("_s", (F.col("at").cast("double") - F.lag("at").over(w).cast("double")) / F.nullif(F.col("done") - F.lag("done").over(w), F.lit(0)))
    return steps.groupBy("job").agg((F.median("_s") * (F.max("total") - F.max("done")) / concurrency).alias("seconds"))


def incremental(source: DataFrame, done_path: str, keys: list[str], process: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Process what is new in a stream and append it; items already done are left out, so a restart repeats nothing."""
    spark = source.sparkSession

    def each(batch: DataFrame, _: int) -> None:
        try:
            done = spark.read.parquet(done_path).select(*keys)
            batch = batch.join(done, keys, "left_anti")
        except Exception as e:  # the first batch finds no results yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        process(batch.dropDuplicates(keys)).write.mode("append").parquet(done_path)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, keys: list[str], window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts in event-time windows; rows later than ``late`` are left out of a stream."""
    own = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, window, slide) if slide else F.window(at, window)
    return own.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    own = events.withWatermark(at, late) if events.isStreaming else events
    return own.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(folder)


def with_heartbeats(events: DataFrame, seconds: int = 15) -> DataFrame:
    """The log with a ``heartbeat`` for every so many silent seconds between two events of a job, under the sequence number of the first."""
    w = Window.partitionBy("job").orderBy("seq")
    gap = F.unix_timestamp(F.lead("at").over(w)) - F.unix_timestamp("at")
    beats = events.withColumn("_n", F.floor((gap - 1) / seconds)).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    empty = {c: F.lit(None).cast(events.schema[c].dataType) for c in events.columns if c not in ("job", "seq", "kind", "at")}
    return events.unionByName(beats.withColumns(empty | {"kind": F.lit("heartbeat"), "at": F.timestamp_seconds(F.unix_timestamp("at") + F.col("_k") * seconds)}).select(*events.columns))
