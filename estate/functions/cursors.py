"""Ingestion cursor values: what they are and how a new position is spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 8601 spellings of a date, a week date, a time and an offset.
_DAY = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})"
_WEEK = r"([0-9]{4})-?W([0-9]{2})(-?([1-7]))?"
_TIME = (
    r"([01][0-9]|2[0-3])(:?[0-5][0-9](:?[0-5][0-9]([.,][0-9]+)?)?)?"
    r"(Z|[+-]([01][0-9]|2[0-3])(:?[0-5][0-9](:?[0-5][0-9])?)?)?"
)
_DATED = rf"^{_DAY}([Tt ]{_TIME})?$"
_WEEKLY = rf"^{_WEEK}([Tt ]{_TIME})?$"


def cursor_date(col: Column | str) -> Column:
    """Calendar date of an ISO date or datetime string, NULL for anything else.

    The shape is tested once and the date cut out and cast, which is cheaper than
    a formatter; week dates are only tried where a ``W`` follows the year.
    """
    raw = F.trim(col)
    cut = lambda start, length: F.substring(raw, start, length)
    compact = F.concat_ws("-", cut(1, 4), cut(5, 2), cut(7, 2))
    dashed = F.when(cut(5, 1) == "-", cut(1, 10)).otherwise(compact)
    return F.when(raw.rlike(_DATED), dashed.try_cast("date")).when(
        F.contains(cut(5, 2), F.lit("W")), _week_date(raw)
    )


def _week_date(raw: Column) -> Column:
    """Date of a year-week-day text: week 1 is the week of 4 January."""
    part = lambda i: F.regexp_extract(raw, _WEEKLY, i)
    first = F.trunc(F.try_to_date(F.concat(part(1), F.lit("-01-04")), "yyyy-MM-dd"), "week")
    week = part(2).try_cast("int")
    day = F.date_add(first, week * 7 + F.coalesce(part(4).try_cast("int"), F.lit(1)) - 8)
    return F.when(F.weekofyear(day) == week, day)


def classify_cursor(value: Column | str, state_type: Column | None = None) -> Column:
    """``xmin`` for transaction-id state, ``date`` for ISO text, else ``opaque``."""
    kind = F.when(cursor_date(value).isNotNull(), F.lit("date")).otherwise(F.lit("opaque"))
    if state_type is None:
        return kind
    return F.when(state_type == "xmin", F.lit("xmin")).otherwise(kind)


def rewrite_date(col: Column | str, target: Column) -> Column:
    """Replace the date before the first ``T``, ``t`` or space; keep all else.

    A dashed date stays dashed and a compact one compact.
    """
    raw = F.trim(col)
    day = F.regexp_extract(raw, r"(?s)^([^Tt ]*)(.*)$", 1)
    rest = F.regexp_extract(raw, r"(?s)^([^Tt ]*)(.*)$", 2)
    dashed = F.date_format(target, "yyyy-MM-dd")
    compact = F.date_format(target, "yyyyMMdd")
    return F.concat(F.when(F.contains(day, F.lit("-")), dashed).otherwise(compact), rest)


def rewrite_xid(
    col: Column | str, value: int | None = None, factor: float | None = None
) -> Column:
    """New transaction id: ``value``, or the old one scaled and rounded half to even.

    NULL where the old value is not a number and has to be scaled.
    """
    if value is not None:
        return F.lit(int(value)).cast("bigint")
    if factor is None:
        raise ValueError("give a value or a factor")
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    old = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.bround(old.cast("double") * F.lit(float(factor)), 0).cast("bigint")
