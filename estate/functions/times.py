"""Points in time without time zones; the test tables hold such timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(moment: datetime) -> Column:
    """A literal that no session or machine time zone can move."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Completed seconds."""
    return F.timestamp_diff("SECOND", start.cast("timestamp_ntz"), end)
