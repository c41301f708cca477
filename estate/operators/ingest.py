"""Ingestion: cursor rewrites, jobs, tags, schedules, connection changes, rosters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.functions import cursors as K
from estate.functions.times import at
from estate.operators.connections import first_of
from estate.plans.shapes import hot_join

# Keys of a sync state as the service writes them.
_COUNT = "cursor_record_count"
_XID_KEYS = ("xmin_xid_value", "xmin_raw_value")


# --- cursor rewrites --------------------------------------------------------

_KEYS = ("connection_id", "namespace", "stream")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _cell(entry: Column) -> Column:
    """One state entry; only text can be a date, a number that looks like one is not."""
    value = entry["value"]
    is_text = F.schema_of_variant(value) == "STRING"
    return F.struct(
        entry["key"].alias("key"), value.alias("value"), _text(value).alias("text"),
        F.when(is_text, K.cursor_date(_text(value))).alias("day"),
        F.coalesce(~is_text & (F.try_variant_get(value, "$", "double") == 0), F.lit(False)).alias("zero"),
    )


def _moves(cell: Column, target: date | None, only_rewind: bool) -> Column:
    if target is None:
        return F.lit(False)
    moves = (cell["key"] != _COUNT) & cell["day"].isNotNull()
    if only_rewind:
        moves = moves & (cell["day"] >= F.lit(target))
    return F.coalesce(moves, F.lit(False))


def _streams(
    state: DataFrame,
    to: date | None,
    xid_value: int | None,
    xid_factor: float | None,
    only_rewind: bool,
) -> DataFrame:
    """Streams with their parsed cells and what would happen to them.

    State that is not a JSON object has no cells and yields nothing later on.
    """
    parsed = F.try_variant_get(F.try_parse_json("state"), "$", "map<string,variant>")
    rows = state.select(*_KEYS, F.transform(F.map_entries(parsed), _cell).alias("_cells"))
    named = lambda key: F.get(
        F.filter("_cells", lambda c: c["key"] == key), F.lit(0)
    )["text"]
    rows = rows.withColumns({
        "_xmin": F.coalesce(named("state_type") == "xmin", F.lit(False)),
        "_rewrote": F.exists("_cells", lambda c: _moves(c, to, only_rewind)),
        "_old": named(_XID_KEYS[0]),
        "_raw": named(_XID_KEYS[1]),
    })
    if xid_value is None and xid_factor is None:
        return rows.withColumns({
            "_new": F.lit(None).cast("bigint"), "_new_raw": F.lit(None).cast("bigint"),
            "_action": F.lit("skip:xmin")})
    rows = rows.withColumns({
        "_new": F.when(F.col("_old").isNotNull(), K.rewrite_xid("_old", xid_value, xid_factor)),
        "_new_raw": F.when(F.col("_raw").isNotNull(), K.rewrite_xid("_raw", xid_value, xid_factor)),
        "_now": K.rewrite_xid("_old", None, 1.0),
    })
    action = F.when(
        (F.col("_old").isNotNull() & F.col("_new").isNull())
        | (F.col("_raw").isNotNull() & F.col("_new_raw").isNull()),
        F.lit("skip:xmin"),
    )
    if only_rewind:
        action = action.when(F.col("_old").isNotNull() & F.col("_now").isNull(), F.lit("skip:xmin"))
        action = action.when(F.col("_new") > F.col("_now"), F.lit("skip:advance"))
    return rows.withColumn("_action", action.otherwise(F.lit("rewrite:xmin")))


def plan_rewrites(
    state: DataFrame,
    to: date | None = None,
    xid_value: int | None = None,
    xid_factor: float | None = None,
    only_rewind: bool = False,
) -> DataFrame:
    """What moving every cursor would do, one row per cursor.

    ``state`` is ``(connection_id, namespace, stream, state)``, one row per stream
    with its state as JSON text. Everything is decided inside the row and in one
    pass, so there is no shuffle. Actions: rewrite, rewrite:xmin, reset:count,
    skip:date, skip:xmin, skip:advance, skip:opaque.
    """
    rows = _streams(state, to, xid_value, xid_factor, only_rewind)
    xid_cell = F.struct(
        F.lit("xmin").alias("key"), F.lit(None).cast("variant").alias("value"),
        F.col("_old").alias("text"), F.lit(None).cast("date").alias("day"), F.lit(False).alias("zero"),
    )
    cell = F.col("_cell")
    standing = F.lit("skip:date" if to is None else "skip:advance")
    action = (
        F.when(F.col("_xmin"), F.col("_action"))
        .when(
            cell["key"] == _COUNT,
            F.when(F.col("_rewrote") & ~cell["zero"], F.lit("reset:count")).otherwise(F.lit("skip:opaque")),
        )
        .when(cell["day"].isNull(), F.lit("skip:opaque"))
        .when(_moves(cell, to, only_rewind), F.lit("rewrite"))
        .otherwise(standing)
    )
    moved_to = K.rewrite_date(F.col("old"), F.lit(to)) if to is not None else F.col("old")
    done = F.col("action")
    new = (
        F.when(done == "rewrite", moved_to)
        .when(done == "reset:count", F.lit("0"))
        .when(done == "rewrite:xmin", F.coalesce(F.col("_new").cast("string"), F.col("old")))
        .otherwise(F.col("old"))
    )
    shown = F.when(F.col("_xmin"), F.array(xid_cell)).otherwise(F.col("_cells"))
    # The outer form, as the plain one adds a filter that parses the state twice.
    return (
        rows.select(*_KEYS, "_xmin", "_rewrote", "_action", "_new", F.explode_outer(shown).alias("_cell"))
        .where(cell.isNotNull())
        .select(*_KEYS, cell["key"].alias("key"), cell["text"].alias("old"), "_new", action.alias("action"))
        .select(*_KEYS, "key", "old", new.alias("new"), "action")
    )


def rewritten_states(
    state: DataFrame,
    to: date | None = None,
    xid_value: int | None = None,
    xid_factor: float | None = None,
    only_rewind: bool = False,
) -> DataFrame:
    """The new state text of every stream that a rewrite changes."""
    rows = _streams(state, to, xid_value, xid_factor, only_rewind)
    moved = F.when(F.col("_xmin"), F.col("_action") == "rewrite:xmin").otherwise(F.col("_rewrote"))

    def fresh(cell: Column) -> Column:
        xid = F.when(cell["key"] == _XID_KEYS[0], F.col("_new")).when(
            cell["key"] == _XID_KEYS[1], F.col("_new_raw"))
        value = F.when(F.col("_xmin"), F.try_parse_json(xid.cast("string")))
        if to is not None:
            day = F.concat(F.lit('"'), K.rewrite_date(cell["text"], F.lit(to)), F.lit('"'))
            value = value.when(_moves(cell, to, only_rewind), F.try_parse_json(day)).when(
                cell["key"] == _COUNT, F.parse_json(F.lit("0")))
        return F.struct(cell["key"].alias("key"), F.coalesce(value, cell["value"]).alias("value"))

    # Exploding an array of no or one state filters without parsing a second time,
    # which a filter pushed below the parse would do.
    changed = F.when(moved, F.array(F.map_from_entries(F.transform("_cells", fresh))))
    return (
        rows.select(*_KEYS, F.explode_outer(changed).alias("_map"))
        .where(F.col("_map").isNotNull())
        .select(*_KEYS, F.to_json("_map").alias("new_state"))
    )


def rewrite_summary(plan: DataFrame, busy: DataFrame) -> DataFrame:
    """One row: cursors and connections that would change, and what busy ones hold back."""
    marks = busy.select("connection_id").distinct().withColumn("_busy", F.lit(True))
    touched = plan.where(F.col("action").startswith("rewrite"))
    per = (
        hot_join(touched, marks, ["connection_id"], "left", by=["stream", "key"])
        .groupBy("connection_id", F.coalesce("_busy", F.lit(False)).alias("_busy"))
        .agg(F.count("*").alias("n"))
    )
    busy_now = F.col("_busy")
    return per.agg(
        F.coalesce(F.sum(F.when(~busy_now, F.col("n"))), F.lit(0)).alias("cursors"),
        F.count_if(~busy_now).alias("connections"),
        F.coalesce(F.sum(F.when(busy_now, F.col("n"))), F.lit(0)).alias("busy_cursors"),
        F.count_if(busy_now).alias("busy_connections"),
    )


# --- jobs -------------------------------------------------------------------

def recent_jobs(
    jobs: DataFrame,
    connection: object | None = None,
    status: str | None = None,
    job_type: str | None = None,
    n: int = 50,
) -> DataFrame:
    """The newest jobs that pass the filters."""
    for column, value in (("connection_id", connection), ("status", status), ("job_type", job_type)):
        if value is not None:
            jobs = jobs.where(F.col(column) == F.lit(value))
    return jobs.orderBy(F.col("start_time").desc_nulls_last(), F.col("job_id").desc()).limit(n)


def started_at(df: DataFrame) -> Column:
    """Start of a job from its start text, else its creation text; NULL if unreadable."""
    text = F.coalesce(F.nullif(F.col("start_text"), F.lit("")), F.col("created_text"))
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def job_health(
    jobs: DataFrame, as_of: datetime, hours: int = 24, by: Sequence[str] = ()
) -> DataFrame:
    """Jobs started in the last day, how many failed, how many are under way."""
    recent = jobs.withColumn("_at", started_at(jobs)).where(
        F.col("_at") >= at(as_of - timedelta(hours=hours))
    )
    state = F.lower("status")
    return recent.groupBy(*by).agg(
        F.count("*").alias("jobs"),
        F.count_if(state == "failed").alias("failed"),
        F.count_if(state.isin("running", "pending")).alias("running"),
    )


def failed_jobs(jobs: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """The failed jobs behind the health figure."""
    return jobs.where(
        (started_at(jobs) >= at(as_of - timedelta(hours=hours))) & (F.lower("status") == "failed")
    ).select("job_id", "connection_id")


# --- tags -------------------------------------------------------------------

def merge_tags(first: Column | str, second: Column | str) -> Column:
    """Union of two tag arrays by id: first-seen order, later value wins.

    Tags are ``struct<tagId, id, name>``; either id spelling counts and tags
    without an id are dropped. The result carries ``tagId`` and ``name``.
    """
    everything = F.flatten(F.array_compact(F.array(first, second)))
    known = F.filter(
        F.transform(everything, lambda t: F.struct(
            F.coalesce(F.nullif(t["tagId"], F.lit("")), t["id"]).alias("tagId"), t["name"].alias("name"))),
        lambda t: F.coalesce(t["tagId"], F.lit("")) != "",
    )

    def last_of_each(tags: Column) -> Column:
        ids = F.array_distinct(F.transform(tags, lambda t: t["tagId"]))
        return F.transform(ids, lambda i: F.element_at(F.filter(tags, lambda t: t["tagId"] == i), -1))

    # One array around it binds the joined list to a name, so it is built once per row.
    return F.transform(F.array(known), last_of_each)[0]


def tag_plan(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct wanted ``(workspace_id, name)`` pairs: which exist, which must be made."""
    have = tags.groupBy("workspace_id", "name").agg(F.max("tag_id").alias("tag_id"))
    return wanted.select("workspace_id", "name").distinct().join(
        have, ["workspace_id", "name"], "left"
    ).withColumn("action", F.when(F.col("tag_id").isNull(), F.lit("create")).otherwise(F.lit("use")))


# --- schedules --------------------------------------------------------------

_FIELD_RANGES = {
    "second": r"[0-5]?[0-9]",
    "minute": r"[0-5]?[0-9]",
    "hour": r"(?:[01]?[0-9]|2[0-3])",
    "day": r"(?:0?[1-9]|[12][0-9]|3[01])",
    "month": r"(?:0?[1-9]|1[0-2]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    "weekday": r"(?:[0-7]|sun|mon|tue|wed|thu|fri|sat)",
    "year": r"(?:19[7-9][0-9]|20[0-9][0-9])",
}
_FIVE = ("minute", "hour", "day", "month", "weekday")


def _item_pattern(name: str) -> str:
    value = _FIELD_RANGES[name]
    item = rf"(?:\*|{value}(?:-{value})?)(?:/[1-9][0-9]*)?"
    if name == "day":
        item = rf"(?:l|{item})"
    if name == "weekday":
        item = rf"(?:l[0-7]|{value}(?:l|#[1-5])|{item})"
    return rf"(?i)^{item}$"


def _fields_fit(parts: Column, names: Sequence[str]) -> Column:
    """Whether there are just these fields and every item of each is valid."""
    def fits(n: int, pattern: str) -> Column:
        items = F.split(F.get(parts, F.lit(n)), ",")
        return F.coalesce(F.forall(items, lambda item: item.rlike(pattern)), F.lit(False))

    return reduce(and_, (fits(n, _item_pattern(name)) for n, name in enumerate(names)), F.size(parts) == len(names))


def split_cron(col: Column | str) -> tuple[Column, Column]:
    """Cron text and the time zone after it, when there are enough fields for one."""
    line = F.trim(F.regexp_replace(col, r"\s+", " "))
    parts = F.split(line, " ")
    last = F.element_at(parts, -1)
    zones = sorted(available_timezones())
    named = (F.size(parts) >= 7) & last.rlike(r"[A-Za-z/_]") & last.isin(*zones)
    bare = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.when(named, bare).otherwise(line), F.when(named, last)


def is_cron(expression: Column) -> Column:
    """Five, six or seven valid fields; six and seven start with seconds."""
    parts = F.split(F.replace(expression, F.lit("?"), F.lit("*")), " ")
    return (
        _fields_fit(parts, _FIVE)
        | _fields_fit(parts, ("second", *_FIVE))
        | _fields_fit(parts, ("second", *_FIVE, "year"))
    )


def schedule_report(connections: DataFrame) -> DataFrame:
    """Schedule of each connection: expression, zone, validity, display text.

    Input: ``connection_id, schedule_type, cron_expression, cron_time_zone,
    basic_timing``. A zone given apart wins over one inside the expression.
    """
    expression, inline = split_cron("cron_expression")
    zone = F.coalesce(F.nullif(F.col("cron_time_zone"), F.lit("")), inline)
    kind, has_cron = F.col("schedule_type"), F.coalesce("cron_expression", F.lit("")) != ""
    shown = (
        F.when(kind.isNull(), F.lit("N/A"))
        .when(has_cron, F.concat_ws(" ", F.concat(kind, F.lit(":"), F.col("expression")), F.col("time_zone")))
        .when((kind == "basic") & F.col("basic_timing").isNotNull(),
              F.concat(F.lit("basic:"), F.col("basic_timing")))
        .otherwise(kind)
    )
    return connections.withColumns({"expression": F.when(has_cron, expression), "time_zone": zone}).select(
        "connection_id", "schedule_type", "expression", "time_zone",
        F.when(has_cron, F.size(F.split("expression", " "))).alias("fields"),
        F.when(has_cron, is_cron(F.col("expression"))).alias("valid"),
        shown.alias("display"),
    )


# --- definitions, changes, rosters -----------------------------------------

def definition_report(definitions: DataFrame, *id_columns: str) -> DataFrame:
    """Connector definitions by whichever id they carry, with their image."""
    return definitions.select(
        first_of(definitions, *id_columns).alias("definition_id"), "name",
        F.concat_ws(":", "docker_repository", "docker_image_tag").alias("image"),
    )


def connection_change_plan(
    connections: DataFrame,
    changes: Mapping[str, str],
    schedule: tuple[str, str | None, str | None] | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Which fields of each connection a bulk update would change.

    ``connections`` are those that passed the filters. ``schedule`` is
    ``(type, expression, zone)`` and is compared as a whole; ``tags`` is
    ``(workspace_id, new_tags)`` and is merged into the connection's own. An update
    that changes nothing is flagged.
    """
    out = connections
    marks = []
    for field, value in changes.items():
        marks.append(F.when(~F.col(field).eqNullSafe(F.lit(value)), F.lit(field)))
    if schedule is not None:
        now = F.struct("schedule_type", "cron_expression", "cron_time_zone")
        then = F.struct(*[F.lit(v).cast("string") for v in schedule])
        marks.append(F.when(~now.eqNullSafe(then), F.lit("schedule")))
    if tags is not None:
        out = hot_join(out, tags, ["workspace_id"], "left", by=["connection_id"])
        out = out.withColumn("merged_tags", merge_tags("tags", "new_tags"))
        before = F.transform("tags", lambda t: F.coalesce(t["tagId"], t["id"]))
        after = F.transform("merged_tags", lambda t: t["tagId"])
        marks.append(F.when(~F.coalesce(before, F.array().cast("array<string>")).eqNullSafe(after), F.lit("tags")))
    changed = F.array_compact(F.array(*marks))
    kept = ["merged_tags"] if tags is not None else []
    return out.select("connection_id", "workspace_id", *kept, changed.alias("changed_fields"),
                      (F.size(changed) == 0).alias("unchanged"))


def ingest_roster(
    items: DataFrame,
    workspaces: DataFrame | None = None,
    include_deleted: bool = False,
    connections: DataFrame | None = None,
    link: str = "source_id",
) -> DataFrame:
    """Sources, destinations or tags of the given workspaces, without deleted ones.

    ``items`` is ``(item_id, name, connector, workspace_id, deleted)``; with
    ``connections`` the number that use each item is added.
    """
    if not include_deleted:
        items = items.where(~F.coalesce("deleted", F.lit(False)))
    if workspaces is not None:
        items = items.join(workspaces.select("workspace_id"), "workspace_id", "left_semi")
    out = items.select("item_id", "name", F.coalesce("connector", F.lit("N/A")).alias("connector"), "workspace_id")
    if connections is None:
        return out
    used = connections.groupBy(F.col(link).alias("item_id")).agg(F.count("*").alias("_n"))
    return out.join(used, "item_id", "left").select(
        *out.columns, F.coalesce("_n", F.lit(0)).cast("bigint").alias("connections")
    )
