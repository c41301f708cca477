"""Query-log triage: live, slow and failed statements.

A log has ``query_id, user_name, target, status, start_time, query_text`` and either
``duration_s`` or ``end_time``; live rows have neither and run until ``as_of``.
Elapsed time is completed seconds everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.functions import text as T
from estate.functions.times import at, seconds_between
from estate.plans.shapes import top_k

# States of a query log, compared in lower case.
LIVE_STATES = ("running", "queued")
FAILED_STATES = ("failed", "aborted", "canceled", "cancelled")

# Spellings of the log columns between engine versions.
COLUMN_SPELLINGS = {
    "query_id": ("query_id", "query", "id"),
    "user_name": ("user_name", "username", "usename"),
    "database_name": ("database_name", "database", "datname"),
    "status": ("status", "state"),
    "start_time": ("start_time", "starttime", "query_start"),
    "end_time": ("end_time", "endtime"),
    "query_text": ("query_text", "querytxt", "query"),
    "session_id": ("session_id", "pid"),
}

# Spellings of the engine's own statement statistics.
STATISTICS_SPELLINGS = {
    "statement": ("query",),
    "calls": ("calls",),
    "total_s": ("total_exec_time", "total_time"),
    "mean_s": ("mean_exec_time", "mean_time"),
    "max_s": ("max_exec_time", "max_time"),
}


def pick(
    df: DataFrame, names: Sequence[str], default: object | None = None, required: bool = False
) -> Column:
    """The first of ``names`` the frame has, else ``default``.

    A missing required column is an error. The choice is made when the plan is
    built, so nothing is read for it.
    """
    lowered = {c.lower(): c for c in df.columns}
    for wanted in names:
        if wanted.lower() in lowered:
            return F.col(lowered[wanted.lower()])
    if required:
        raise ValueError(f"none of {list(names)} among {df.columns}")
    return F.lit(default)


def normalise_log(df: DataFrame) -> DataFrame:
    """Bring a log with drifting column names to the names used here."""
    spell = COLUMN_SPELLINGS
    extra = [c for c in ("target", "duration_s") if c in df.columns]
    return df.select(
        *extra,
        pick(df, spell["query_id"], required=True).cast("string").alias("query_id"),
        pick(df, spell["user_name"], "").alias("user_name"),
        pick(df, spell["database_name"], "").alias("database_name"),
        pick(df, spell["status"]).cast("string").alias("status"),
        pick(df, spell["start_time"], required=True).alias("start_time"),
        pick(df, spell["end_time"]).cast("timestamp_ntz").alias("end_time"),
        pick(df, spell["query_text"], "").alias("query_text"),
        pick(df, spell["session_id"]).cast("string").alias("session_id"),
    )


def is_live(df: DataFrame) -> Column:
    """Running or queued; without a status column, a row with no end is live."""
    if "status" in df.columns:
        return F.coalesce(F.lower("status").isin(*LIVE_STATES), F.lit(False))
    if "end_time" in df.columns:
        return F.col("end_time").isNull()
    return F.col("duration_s").isNull()


def clock(as_of: datetime | None) -> Column:
    """The given time, or the time of the batch."""
    return at(as_of) if as_of is not None else F.current_timestamp().cast("timestamp_ntz")


def with_elapsed(log: DataFrame, as_of: datetime | None) -> DataFrame:
    """Add ``is_live`` and ``elapsed_s``."""
    start, now = F.col("start_time"), clock(as_of)
    ends = seconds_between(start, F.coalesce("end_time", now)) if "end_time" in log.columns else (
        seconds_between(start, now)
    )
    spent = F.coalesce("duration_s", ends) if "duration_s" in log.columns else ends
    return log.withColumns({"is_live": is_live(log), "elapsed_s": spent.cast("bigint")})


def _newest_first(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return top_k(df, ["target"], order, n).select(
        "target", "rank", "query_id", "user_name", "status", "start_time", "elapsed_s",
        T.fold_sql("query_text").alias("query_text"),
    )


def triage_filter(log: DataFrame, as_of: datetime | None, min_s: int = 60, hours: float = 6) -> DataFrame:
    """Rows worth a look: slow and live or recent, or failed and recent."""
    timed = with_elapsed(log, as_of)
    recent = F.col("start_time") >= clock(as_of) - F.expr(f"INTERVAL '{hours * 3600:.6f}' SECOND")
    failed = F.coalesce(F.lower("status").isin(*FAILED_STATES), F.lit(False))
    slow = F.col("elapsed_s") >= min_s
    return timed.where((slow & (F.col("is_live") | recent)) | (failed & recent))


def triage(
    log: DataFrame, as_of: datetime, min_s: int = 60, hours: float = 6, n: int = 20
) -> DataFrame:
    """The ``n`` most urgent statements per target: live first, then the longest."""
    order = [F.col("is_live").desc(), F.col("elapsed_s").desc(), F.col("query_id")]
    return _newest_first(triage_filter(log, as_of, min_s, hours), order, n)


def live_queries(log: DataFrame, as_of: datetime, min_s: int = 60, n: int = 20) -> DataFrame:
    """Running or queued statements of at least ``min_s``, however old."""
    live = with_elapsed(log, as_of).where(F.col("is_live") & (F.col("elapsed_s") >= min_s))
    return _newest_first(live, [F.col("elapsed_s").desc(), F.col("query_id")], n)


def activity_snapshot(
    sessions: DataFrame, as_of: datetime, min_s: int = 0, n: int = 20, own_session: str | None = None
) -> DataFrame:
    """Sessions at work now: with a state other than idle and a start; not our own."""
    busy = sessions.where(
        F.col("state").isNotNull() & (F.col("state") != "idle") & F.col("start_time").isNotNull()
    )
    if own_session is not None:
        busy = busy.where(F.col("session_id") != own_session)
    spent = seconds_between(F.col("start_time"), at(as_of)).cast("bigint")
    timed = busy.withColumn("elapsed_s", spent).where(F.col("elapsed_s") >= min_s)
    return top_k(timed, ["target"], [F.col("elapsed_s").desc(), F.col("session_id")], n).select(
        "target", "rank", "session_id", "user_name", "state", "elapsed_s",
        T.fold_sql("query_text").alias("query_text"),
    )


def statement_stats(log: DataFrame, min_s: float = 0, n: int = 20) -> DataFrame:
    """Calls and total, mean and longest seconds per normalised statement.

    ``log`` has ``elapsed_ms``; statements whose longest call stays below
    ``min_s`` are left out. Statements are told apart by their whole text; only what
    is shown of them is cut.
    """
    seconds = F.col("elapsed_ms") / F.lit(1000.0)
    stats = (
        log.groupBy("target", T.fold_space("query_text").alias("statement"))
        .agg(
            F.count("*").alias("calls"),
            F.sum(seconds).alias("total_s"),
            F.avg(seconds).alias("mean_s"),
            F.max(seconds).alias("max_s"),
        )
        .where(F.col("max_s") >= min_s)
    )
    top = top_k(stats, ["target"], [F.col("max_s").desc(), F.col("statement")], n)
    return top.withColumn("statement", T.fold_sql("statement"))


def engine_statistics(stats: DataFrame, min_s: float = 0, n: int = 20) -> DataFrame:
    """The slowest statements per target from statistics the engine has aggregated.

    Takes both spellings of the columns, times in milliseconds. Rows are not summed
    again; ties are in the order of calls and of the whole statement.
    """
    spell = STATISTICS_SPELLINGS
    seconds = {c: pick(stats, spell[c], required=True) / F.lit(1000.0) for c in ("total_s", "mean_s", "max_s")}
    wanted = stats.select(
        "target", T.fold_space(pick(stats, spell["statement"], required=True)).alias("statement"),
        pick(stats, spell["calls"], required=True).cast("bigint").alias("calls"),
        *[c.alias(name) for name, c in seconds.items()],
    ).where(F.col("max_s") >= min_s)
    order = [F.col("max_s").desc(), F.col("calls").desc(), F.col("statement")]
    return top_k(wanted, ["target"], order, n).withColumn("statement", T.fold_sql("statement"))


def classify_log(log: DataFrame, text: str = "query_text") -> DataFrame:
    """Every logged statement as read or write, with a one-line preview."""
    return log.withColumns({
        "statement_kind": T.classify_sql(text),
        "statement_preview": T.preview(text),
    })


def long_running_counts(
    log: DataFrame, targets: DataFrame, as_of: datetime, threshold_s: int = 60
) -> DataFrame:
    """Live statements over the threshold per target.

    ``targets`` has ``target`` and ``has_sessions``; a target whose engine keeps
    no session catalog gets NULL, one without long statements gets 0.
    """
    live = with_elapsed(log, as_of).where(F.col("is_live") & (F.col("elapsed_s") >= threshold_s))
    counts = live.groupBy("target").agg(F.count("*").alias("_n"))
    known = F.coalesce("_n", F.lit(0))
    return targets.join(counts, "target", "left").select(
        "target", F.when(F.col("has_sessions"), known).cast("bigint").alias("long_running")
    )
