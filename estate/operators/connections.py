"""Connection filters: status, owner, selected streams, busy connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.plans.shapes import top_k

# Job states that mean work is under way.
BUSY_STATES = ("running", "pending", "incomplete")


def first_of(df: DataFrame, *names: str) -> Column:
    """First non-NULL of the spellings of a field that the frame has."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        raise ValueError(f"none of {names} among {df.columns}")
    return F.coalesce(*present)


def filter_connections(
    df: DataFrame,
    active_only: bool = False,
    source: object | None = None,
    destination: object | None = None,
    workspace: object | None = None,
    status: str | None = None,
) -> DataFrame:
    """Connections that pass every given filter; both spellings of ids are read."""
    if active_only:
        df = df.where(F.lower("status") == "active")
    if status is not None:
        df = df.where(F.lower("status") == status.lower())
    wanted = {
        ("sourceId", "source_id"): source,
        ("destinationId", "destination_id"): destination,
        ("workspaceId", "workspace_id"): workspace,
    }
    for spellings, value in wanted.items():
        if value is not None:
            df = df.where(first_of(df, *spellings) == F.lit(value))
    return df


def has_active_streams(streams: Column | str) -> Column:
    """True when any stream is selected in its config, itself or its stream part.

    ``streams`` is an array of ``struct<config: struct<selected>, selected,
    stream: struct<selected>>``.
    """

    def chosen(item: Column) -> Column:
        flags = (item["config"]["selected"], item["selected"], item["stream"]["selected"])
        return F.coalesce(flags[0], F.lit(False)) | F.coalesce(flags[1], F.lit(False)) | F.coalesce(
            flags[2], F.lit(False)
        )

    return F.coalesce(F.exists(streams, chosen), F.lit(False))


def idle_connections(df: DataFrame, streams: str = "streams") -> DataFrame:
    """Active connections with no selected stream."""
    return df.where(F.lower("status") == "active").where(~has_active_streams(streams))


def busy_connections(jobs: DataFrame, last_n: int = 5) -> DataFrame:
    """Connections with work under way among their ``last_n`` newest jobs."""
    order = [F.col("start_time").desc_nulls_last(), F.col("job_id").desc()]
    newest = top_k(jobs.select("connection_id", "job_id", "status", "start_time"),
                   ["connection_id"], order, last_n)
    busy = F.lower("status").isin(*BUSY_STATES)
    return (
        newest.groupBy("connection_id")
        .agg(F.count_if(busy).alias("busy_jobs"))
        .where("busy_jobs > 0")
    )


def filter_roles(
    df: DataFrame,
    contains: str | None = None,
    users_only: bool = False,
    groups_only: bool = False,
) -> DataFrame:
    """Roles by case-insensitive substring; users or groups only, not both."""
    if users_only and groups_only:
        raise ValueError("users_only and groups_only exclude each other")
    if contains:
        df = df.where(F.contains(F.lower("role"), F.lit(contains.lower())))
    if users_only:
        df = df.where("can_login")
    if groups_only:
        df = df.where("NOT can_login")
    return df


def without_owner_rows(grants: DataFrame) -> DataFrame:
    """Grant listing without the OWNER pseudo-grants."""
    return grants.where(F.col("privilege") != "OWNER")

