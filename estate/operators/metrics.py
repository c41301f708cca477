"""Resource metrics: summaries, thresholds, series, dimension choice, rosters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.functions import units as U
from estate.functions.times import at
from estate.plans.shapes import hot_join

_GIB = 1024**3
# Metric -> (direction, warning level, critical level).
THRESHOLDS = {
    "CPUUtilization": ("above", 70, 90),
    "FreeableMemory": ("below", _GIB, _GIB // 2),
    "FreeStorageSpace": ("below", 20 * _GIB, 5 * _GIB),
    "DatabaseConnections": ("above", 200, 400),
    "EBSByteBalance%": ("below", 40, 20),
    "EBSIOBalance%": ("below", 40, 20),
}
# Units of the metrics a service reports without one.
METRIC_UNITS = {
    "CPUUtilization": "Percent",
    "FreeableMemory": "Bytes",
    "FreeStorageSpace": "Bytes",
    "DatabaseConnections": "Count",
    "EBSByteBalance%": "Percent",
    "EBSIOBalance%": "Percent",
    "ComputeSeconds": "Seconds",
    "QueryDuration": "Microseconds",
    "DataStorage": "Megabytes",
}


def periods(points: DataFrame, period_s: int) -> DataFrame:
    """Average, smallest and biggest value per scope, metric and period."""
    return (
        points.groupBy("scope", "metric", F.window("ts", f"{period_s} seconds").alias("_w"))
        .agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
        .select("scope", "metric", F.col("_w.start").alias("start"), "avg", "min", "max")
    )


def in_window(points: DataFrame, as_of: datetime, hours: float) -> DataFrame:
    return points.where(
        (F.col("ts") >= at(as_of - timedelta(hours=hours))) & (F.col("ts") < at(as_of))
    )


def metric_summary(
    points: DataFrame,
    as_of: datetime,
    hours: float = 1,
    period_s: int = 300,
    expected: DataFrame | None = None,
) -> DataFrame:
    """Latest, average, smallest and biggest value per scope and metric.

    The average is the mean of the period averages. Pairs in ``expected`` that
    have no points keep a row of NULLs.
    """
    summary = (
        periods(in_window(points, as_of, hours), period_s)
        .groupBy("scope", "metric")
        .agg(
            F.max_by("avg", "start").alias("latest"),
            F.avg("avg").alias("average"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
        )
    )
    if expected is None:
        return summary
    return expected.select("scope", "metric").distinct().join(summary, ["scope", "metric"], "left")


def threshold_state(
    summary: DataFrame,
    rules: dict[str, tuple[str, float, float]] | None = None,
    value: str = "latest",
) -> DataFrame:
    """Add ``state`` (ok, warn, crit; NULL without a rule or value) and ``shown`` text."""
    level = F.col(value)
    state = F.when(level.isNull(), F.lit(None).cast("string"))
    for metric, (direction, warn, crit) in (THRESHOLDS if rules is None else rules).items():
        over = (lambda limit: level >= limit) if direction == "above" else (lambda limit: level < limit)
        verdict = F.when(over(crit), F.lit("crit")).when(over(warn), F.lit("warn")).otherwise(F.lit("ok"))
        state = state.when(F.col("metric") == metric, verdict)
    unit = F.coalesce(*[F.when(F.col("metric") == m, F.lit(u)) for m, u in METRIC_UNITS.items()])
    return summary.withColumns({
        "state": state, "shown": U.format_metric(level, unit, F.col("metric"))})


def metric_series(points: DataFrame, period_s: int = 300) -> DataFrame:
    """Period averages in display units with the first lowest and highest marked.

    The extremes are aggregated and joined back with the series spread over many
    tasks, so one long series is never sorted in one place.
    """
    metric = F.col("metric")
    shown = U.display_value(F.col("avg"), metric)
    capped = F.when(U.is_percent_metric(metric), F.least(shown, F.lit(100.0))).otherwise(shown)
    series = periods(points, period_s).select("scope", "metric", "start", capped.alias("value"))
    extremes = series.groupBy("scope", "metric").agg(
        F.min(F.struct("value", "start")).alias("_low"),
        F.min(F.struct((-F.col("value")).alias("v"), "start")).alias("_high"),
    )
    return hot_join(series, extremes, ["scope", "metric"], by=["start"]).select(
        "scope", "metric", "start", "value",
        (F.col("start") == F.col("_low.start")).alias("is_min"),
        (F.col("start") == F.col("_high.start")).alias("is_max"),
    )


def pick_dimensions(series: DataFrame, base: Sequence[str]) -> DataFrame:
    """The least specific dimension set per metric and base values.

    ``series`` is ``(series_id, metric, dims)`` with dims a map. Candidates carry
    every base dimension; the smallest set wins, the smallest id on ties.
    """
    values = [F.try_element_at("dims", F.lit(name)) for name in base]
    has_all: Column = F.lit(True)
    for value in values:
        has_all = has_all & value.isNotNull()
    scope = F.struct(*[v.alias(n) for n, v in zip(base, values, strict=True)])
    rank = F.struct(F.size("dims").alias("size"), F.col("series_id"))
    return (
        series.where(has_all)
        .groupBy("metric", scope.alias("base"))
        .agg(F.min_by(F.struct("series_id", "dims"), rank).alias("_best"), F.count("*").alias("candidates"))
        .select("metric", "base", "candidates", F.col("_best.series_id").alias("series_id"),
                F.col("_best.dims").alias("dims"))
    )


def instance_roster(instances: DataFrame) -> DataFrame:
    """Instances with class, engine and version, status, storage."""
    return instances.select(
        "identifier", "class",
        F.trim(F.concat_ws(" ", "engine", "engine_version")).alias("engine"), "status",
        F.col("allocated_storage").alias("storage_gb"),
        F.coalesce("multi_az", F.lit(False)).alias("multi_az"),
    )
