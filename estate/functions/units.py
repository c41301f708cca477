"""Metric values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estate.functions.text import UNKNOWN

_GB = 1024.0**3


def is_byte_metric(metric: Column) -> Column:
    return F.contains(metric, F.lit("Memory")) | F.contains(metric, F.lit("Storage"))


def is_percent_metric(metric: Column) -> Column:
    return (metric == "CPUUtilization") | metric.endswith("%")


def format_metric(value: Column, unit: Column, metric: Column) -> Column:
    """Text by unit: bytes and megabytes as GB, percent, times, counts rounded."""
    number = value.cast("double")
    return (
        F.when(number.isNull(), F.lit(UNKNOWN))
        .when(unit == "Percent", F.format_string("%.2f%%", number))
        .when(unit == "Bytes", F.format_string("%.2f GB", number / F.lit(_GB)))
        .when(unit == "Megabytes", F.format_string("%.2f GB", number / F.lit(1024.0)))
        .when(unit.isin("Milliseconds", "Microseconds"), F.format_string("%.2f %s", number, unit))
        .when(unit == "Seconds", F.format_string("%.2fs", number))
        .when(metric.endswith("Count"), F.bround(number, 0).cast("bigint").cast("string"))
        .otherwise(F.format_string("%.2f", number))
    )


def display_value(value: Column, metric: Column) -> Column:
    """Number for a chart: bytes as GB, everything else as it is."""
    return F.when(is_byte_metric(metric), value / F.lit(_GB)).otherwise(value)
