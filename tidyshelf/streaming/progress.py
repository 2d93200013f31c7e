"""Job progress from an event table or stream: latest state, speed, ETA, log tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

TERMINAL = ["pipeline_complete", "pipeline_error"]
MIN_ELAPSED = 0.05


def _speed(processed: Column, elapsed: Column) -> Column:
    return F.when(processed > 0, F.round(processed / F.greatest(elapsed, F.lit(MIN_ELAPSED)), 1)
                  ).otherwise(F.lit(0.0))


def _eta(processed: Column, total: Column, speed: Column) -> Column:
    open_ = (processed > 0) & (total > processed) & (speed > 0)
    return F.when(open_, F.round((total - processed) / speed, 1)).otherwise(F.lit(0.0))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def progress(events: DataFrame, job: str = "job_id", ts: str = "ts", processed: str = "processed",
             total: str = "total", event: str = "event") -> DataFrame:
    """Latest state per job with rows per second and remaining seconds.

    One partially aggregated groupBy, so a job that owns most events is no hot
    spot. Works on a table and, in update or complete mode, on a stream.
    """
    last = F.struct(F.col(ts), F.col(event), F.col(processed))
    state = events.groupBy(job).agg(
        F.max(last).alias("last"), F.min(ts).alias("started"), F.max(ts).alias("updated"),
        F.max(total).alias("total"), F.max(processed).alias("processed"),
        F.count(F.lit(1)).alias("event_count"))
    elapsed = seconds(F.col("updated")) - seconds(F.col("started"))
    speed = _speed(F.col("processed"), elapsed)
    return state.select(
        job, F.col(f"last.{event}").alias("last_event"), "processed", "total", "event_count",
        F.round(elapsed, 3).alias("elapsed_seconds"), speed.alias("speed"),
        _eta(F.col("processed"), F.col("total"), speed).alias("eta_seconds"),
        F.col(f"last.{event}").isin(TERMINAL).alias("finished"))


def log_tail(events: DataFrame, job: str = "job_id", ts: str = "ts", tie: str = "event_id",
             lines: int = 100) -> DataFrame:
    """Last lines per job; each task keeps only its own last lines before the shuffle."""
    order = W.partitionBy(job).orderBy(F.desc(ts), F.desc(tie))
    return events.withColumn("line", F.row_number().over(order)).where(F.col("line") <= lines)


def windowed_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour",
                    slide: str | None = None, late: str = "10 minutes",
                    value: str | None = None) -> DataFrame:
    """Events per key and time window; the watermark bounds the state of a stream."""
    # A watermark needs a zoned timestamp.
    marked = (events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
              if events.isStreaming else events)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    aggs = [F.count(F.lit(1)).alias("event_count")]
    if value:
        aggs.append(F.round(F.sum(F.col(value).cast("decimal(18,4)")), 2).cast("double")
                    .alias("value_sum"))
    return marked.groupBy(window, key).agg(*aggs).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key,
        *[a for a in ("event_count", "value_sum") if a == "event_count" or value])


def keep_latest(frame: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Runs an aggregated stream over what has arrived; ``latest`` reads its result from ``target``.

    Only rows that changed are written, each trigger's into its own partition, so a replay replaces
    them, and the watermark of the stream bounds its state.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .partitionBy("batch_id").option("partitionOverwriteMode", "dynamic").parquet(target))

    return (frame.writeStream.outputMode("update").foreachBatch(land)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest(landed: DataFrame, *keys: str) -> DataFrame:
    """The last state of each key among the changes that a stream wrote."""
    others = [c for c in landed.columns if c not in (*keys, "batch_id")]
    return landed.groupBy(*keys).agg(
        F.max_by(F.struct(*others), "batch_id").alias("state")).select(*keys, "state.*")
