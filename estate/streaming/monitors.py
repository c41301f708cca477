"""Metric summaries, query alerts and job health as streams.

Event-time columns are cast to TIMESTAMP, which watermarks need. Each function
takes a streaming frame and returns one; :func:`run_available` drains what is
there now into Parquet files and hands them back as a batch frame.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estate.operators.querylog import is_live, triage_filter


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet files as they arrive under ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def metric_stream(points: DataFrame, period: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Summary per scope, metric and period, out when the period can no longer change."""
    return (
        points.withColumn("t", F.col("ts").cast("timestamp"))
        .withWatermark("t", delay)
        .groupBy(F.window("t", period).alias("w"), "scope", "metric")
        .agg(F.count("*").alias("points"), F.avg("value").alias("avg"),
             F.min("value").alias("min"), F.max("value").alias("max"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("start"),
                "scope", "metric", "points", "avg", "min", "max")
    )


def outlasting_stream(log: DataFrame, min_s: int = 60, delay: str = "1 hour") -> DataFrame:
    """Live statements that were not seen to end within ``min_s`` seconds of their start.

    Live rows wait in state for the end row of their statement. One that comes in time
    takes them away; if none has come when the watermark, which follows starts and ends
    alike, passes their start plus ``min_s``, they come out, once per row handed in.
    State holds the statements of the last ``delay`` and ``min_s``, not the log. A live
    row that starts before the watermark is too late to wait; :func:`alert_stream` looks
    at it when it arrives. Rows without an id never match an end.
    """
    live = is_live(log)
    spent = F.col("start_time").cast("timestamp") + F.make_dt_interval(secs=F.col("duration_s")) if (
        "duration_s" in log.columns) else F.lit(None).cast("timestamp")
    ends = F.coalesce(F.col("end_time").cast("timestamp"), spent) if "end_time" in log.columns else spent
    waiting = log.where(live).withColumn("t", F.col("start_time").cast("timestamp")).withWatermark("t", delay)
    ended = (
        log.where(~live).select(F.col("query_id").alias("_id"), ends.alias("_end"))
        .where("_end is not null").withWatermark("_end", delay)
    )
    soon = F.expr(f"t + INTERVAL '{min_s}' SECOND")
    met = (F.col("query_id") == F.col("_id")) & (F.col("_end") >= F.col("t")) & (F.col("_end") < soon)
    return waiting.join(ended, met, "left_outer").where("_id is null").drop("_id", "_end").withColumns(
        {"is_live": F.lit(True), "elapsed_s": F.lit(min_s).cast("bigint")}
    )


def alert_stream(
    log: DataFrame, as_of: datetime | None = None, min_s: int = 60, hours: float = 6, delay: str = "1 hour"
) -> DataFrame:
    """Slow and failed statements of a growing log, each reported once.

    Every row is looked at when it arrives, with the filter of the batch triage: by the
    clock of its micro-batch, so the look-back moves on, or by ``as_of``, which replays a
    log as of one time. Without ``as_of`` a live statement that is not slow yet waits for
    its end (:func:`outlasting_stream`) and is reported when it has outlasted ``min_s``,
    with ``elapsed_s`` at that; it need not be handed in again. The ids of alerts are
    remembered for as long as the watermark allows repeats. The watermark follows all
    rows, not alerts alone.
    """
    timed = log.withColumn("t", F.col("start_time").cast("timestamp")).withWatermark("t", delay)
    found = triage_filter(timed, as_of, min_s, hours)
    if as_of is None:
        found = found.unionByName(outlasting_stream(log, min_s, delay))
    return found.dropDuplicatesWithinWatermark(["query_id"]).drop("t")


def job_health_stream(
    jobs: DataFrame, span: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Jobs, failures and jobs under way per sliding window.

    Jobs are counted per slide first, so a row enters one small group and only the
    counts are repeated for the windows that overlap it.
    """
    state = F.lower("status")
    hourly = (
        jobs.withColumn("t", F.col("start_time").cast("timestamp"))
        .withWatermark("t", delay)
        .groupBy(F.window("t", slide).alias("w"))
        .agg(F.count("*").alias("jobs"), F.count_if(state == "failed").alias("failed"),
             F.count_if(state.isin("running", "pending")).alias("running"))
    )
    return (
        hourly.groupBy(F.window(F.window_time("w"), span, slide).alias("s"))
        .agg(F.sum("jobs").alias("jobs"), F.sum("failed").alias("failed"),
             F.sum("running").alias("running"))
        .select(F.col("s.start").cast("timestamp_ntz").alias("start"), "jobs", "failed", "running")
    )


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Process everything there is, then return the result as a batch frame.

    Output and state live below ``path``, which the caller names and all executors
    share. Called again with the same path the query goes on where it stopped: files
    already counted are not read again, and the frame holds the rows of all calls.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
