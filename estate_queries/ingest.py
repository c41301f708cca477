"""Ingestion state, jobs, tags, schedules, rosters and BI users."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from estate.functions import cursors as K
from estate.operators import bi as B
from estate.operators import connections as C
from estate.operators import ingest as I
from estate_queries import fixtures as X
from estate_queries.fixtures import CLOCK, CLOCK_SQL, with_fx

TO = date(1997, 6, 1)


def _state(spark, d):
    """Cursor state as JSON text; counts are numbers there."""
    state = X.cursor_state(spark, d)
    text = F.regexp_replace(F.to_json("state"), r'"cursor_record_count":"(\d+)"', r'"cursor_record_count":$1')
    return state.withColumn("state", text)


def _classify(spark, d):
    value = F.coalesce(F.col("state")["cursor"], F.col("state")["xmin_xid_value"])
    return X.cursor_state(spark, d).select(
        "connection_id", "stream", value.alias("value"),
        K.classify_cursor(value, F.col("state")["state_type"]).alias("cursor_kind"))


def _plan(spark, d, **kw):
    return I.plan_rewrites(_state(spark, d), **kw)


def _summary(spark, d):
    plan = _plan(spark, d, to=TO, xid_factor=0.5)
    return I.rewrite_summary(plan, C.busy_connections(X.jobs(spark, d)))


def _states(spark, d):
    out = I.rewritten_states(_state(spark, d), to=TO, xid_value=77, only_rewind=True)
    state = F.from_json("new_state", "map<string,string>")
    return out.select("connection_id", "stream", state["cursor"].alias("cursor"),
                      state["cursor_record_count"].alias("record_count"),
                      state["xmin_xid_value"].alias("xid"), state["xmin_raw_value"].alias("raw"),
                      state["state_type"].alias("state_type"))


def _recent(spark, d):
    return I.recent_jobs(X.jobs(spark, d), status="failed", job_type="sync", n=40)


def _texts(spark, d):
    key = F.col("job_id")
    text = F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return X.jobs(spark, d).select(
        "job_id", "connection_id", F.initcap("status").alias("status"), "job_type",
        F.when(key % 5 != 0, text).when(key % 10 == 0, F.lit("")).otherwise(F.lit("soon")).alias("start_text"),
        F.when(key % 20 != 0, text).alias("created_text"))


def _health(spark, d):
    return I.job_health(_texts(spark, d), CLOCK, hours=72, by=["job_type"])


def _tag(tag_id, other, name):
    return F.struct(tag_id.cast("string").alias("tagId"), other.cast("string").alias("id"), name.alias("name"))


def _tag_arrays(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None)
    first = F.array(_tag(X.s(key % 3), none, F.lit("a")), _tag(none, X.s(key % 4), F.lit("b")),
                    _tag(none, none, F.lit("lost")))
    second = F.when(cust % 5 != 0, F.array(_tag(X.s(cust % 4), X.s(key), F.lit("c")), _tag(none, X.s(key % 3), F.lit("d"))))
    return X.table(spark, d, "orders").select(key.alias("connection_id"), first.alias("a"), second.alias("b"))


def _merge(spark, d):
    merged = F.transform(I.merge_tags("a", "b"), lambda t: F.concat(t["tagId"], F.lit("="), t["name"]))
    return _tag_arrays(spark, d).select("connection_id", F.array_join(merged, ",").alias("tags"))


def _tags(spark, d):
    part = X.table(spark, d, "part")
    wanted = part.select(X.half("p_partkey", 20).alias("workspace_id"), F.concat("p_type", F.lit("/"), "p_brand").alias("name"))
    have = X.table(spark, d, "part").where("p_size > 25").select(
        X.half("p_partkey", 20).alias("workspace_id"), F.concat("p_type", F.lit("/"), "p_brand").alias("name"),
        F.col("p_partkey").alias("tag_id"))
    return I.tag_plan(wanted, have)


def _schedules(spark, d):
    key = F.col("c_custkey")
    minute, hour = X.s(key % 70), X.s(key % 24)
    cron = (
        F.when(key % 8 == 0, F.concat(F.lit("0 "), minute, F.lit(" "), hour, F.lit(" * * ?")))
        .when(key % 8 == 1, F.concat(F.lit("0  "), minute, F.lit(" "), hour, F.lit(" ? * MON-FRI Europe/Paris ")))
        # One in five of these is a valid list of thousands of characters.
        .when(key % 40 == 10, F.concat(F.repeat(F.concat(minute, F.lit(",")), F.lit(2500)), minute, F.lit(" */6 1,15 * *")))
        .when(key % 8 == 2, F.concat(minute, F.lit(" */6 1,15 * *")))
        .when(key % 8 == 3, F.concat(F.lit("0 "), minute, F.lit(" "), hour, F.lit(" * * ? Mars/Base")))
        .when(key % 8 == 4, F.concat(F.lit("0 "), minute, F.lit(" "), hour, F.lit(" L * ? 2030 UTC")))
        .when(key % 8 == 5, F.concat(minute, F.lit(" "), hour)))
    kind = F.when(key % 8 <= 5, "cron").when(key % 8 == 6, F.when(key % 16 == 6, "basic").otherwise("manual"))
    return I.schedule_report(X.table(spark, d, "customer").select(
        key.alias("connection_id"), kind.alias("schedule_type"), cron.alias("cron_expression"),
        F.when(key % 16 == 1, F.lit("Asia/Tokyo")).alias("cron_time_zone"),
        F.when(key % 16 == 6, F.concat(F.lit("Every "), hour, F.lit(" HOURS"))).alias("basic_timing")))


def _definitions(spark, d):
    key = F.col("p_partkey")
    return I.definition_report(X.table(spark, d, "part").select(
        F.when(key % 2 == 0, X.name("d", key)).alias("definitionId"), F.when(key % 2 == 1, X.name("s", key)).alias("id"),
        F.col("p_name").alias("name"), F.concat(F.lit("img/"), F.lower("p_type")).alias("docker_repository"),
        F.when(key % 3 != 0, X.s("p_size")).alias("docker_image_tag")), "definitionId", "id")


def _changes(spark, d):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    conns = X.table(spark, d, "orders").select(
        key.alias("connection_id"), (cust % 30).alias("workspace_id"),
        F.when(F.col("o_orderstatus") == "F", "active").otherwise("inactive").alias("status"),
        F.when(key % 4 != 0, F.lit("raw_")).alias("prefix"), (cust % 3).alias("sourceId"),
        F.when(key % 2 == 0, "cron").otherwise("manual").alias("schedule_type"),
        F.when(key % 2 == 0, F.when(key % 6 == 0, "0 0 1 * * ?").otherwise("0 0 2 * * ?")).alias("cron_expression"),
        F.when(key % 2 == 0, F.lit("UTC")).alias("cron_time_zone"),
        F.when(cust % 7 != 0, F.array(_tag(X.s(cust % 5), F.lit(None), F.lit("t")))).alias("tags"))
    tags = X.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("workspace_id"),
        F.array(_tag(F.lit(None), X.s(F.col("n_regionkey")), F.col("n_name"))).alias("new_tags"))
    plan = I.connection_change_plan(
        C.filter_connections(conns, source=1), {"status": "active", "prefix": "raw_"},
        ("cron", "0 0 1 * * ?", "UTC"), tags)
    merged = F.transform("merged_tags", lambda t: t["tagId"])
    return plan.select("connection_id", F.array_join("changed_fields", ",").alias("changed_fields"), "unchanged",
                       F.coalesce(F.array_join(merged, ","), F.lit("")).alias("tag_ids"))


def _roster(spark, d):
    sources = X.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 3 != 0, F.lit("postgres")).alias("connector"),
        F.col("s_nationkey").alias("workspace_id"), (F.col("s_acctbal") < 0).alias("deleted"))
    spaces = X.table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("workspace_id"))
    conns = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"))
    return I.ingest_roster(sources, spaces, connections=conns)


def _users(spark, d):
    return X.bi_users(spark, d).withColumns(
        {"role_ids": B.id_list("roles"), "group_ids": B.id_list("groups")})


def _resolve(spark, d):
    names = X.table(spark, d, "customer").select(
        F.concat(F.lit("Nation_"), X.s(F.col("c_nationkey") + F.col("c_custkey") % 4)).alias("name"))
    dim = X.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return B.resolve_ids(names, dim)


def _filter(spark, d):
    users = _users(spark, d)
    out = None
    for mode in ("exact", "subset", "any"):
        part = B.filter_users(users, [2, 7], mode).select("user_id", F.lit(mode).alias("mode"))
        out = part if out is None else out.unionByName(part)
    mail = B.filter_users(users, emails=["USER7@example.org", "user8@EXAMPLE.org"]).select(
        "user_id", F.lit("email").alias("mode"))
    return out.unionByName(mail)


def _group_plan(spark, d):
    users = _users(spark, d)
    parts = {"change": B.group_change_plan(users, add=[1, 5], remove=[0]),
             "set": B.group_change_plan(users, set_=[2]), "clear": B.group_change_plan(users, set_=[])}
    out = None
    for mode, plan in parts.items():
        rows = plan.select("user_id", F.lit(mode).alias("mode"),
                           F.array_join(F.col("groups_before").cast("array<string>"), ",").alias("before"),
                           F.array_join(F.col("groups_after").cast("array<string>"), ",").alias("after"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _user_roster(spark, d):
    roles = X.table(spark, d, "region").select(
        F.col("r_regionkey").cast("bigint").alias("role_id"), F.col("r_name").alias("role_name"))
    return B.user_roster(_users(spark, d), roles)


def _member_roster(spark, d):
    groups = X.table(spark, d, "region").select(
        F.col("r_regionkey").cast("bigint").alias("group_id"), F.col("r_name").alias("group_name"))
    return B.member_roster(_users(spark, d), groups, "group_ids", "group_id", "group_name")


QUERIES = {
    "i1_classify_cursors": _classify,
    "i4_plan_rewrites": lambda s, d: _plan(s, d, to=TO, xid_factor=0.5),
    "i4_plan_rewind_only": lambda s, d: _plan(s, d, to=TO, xid_value=9000000, only_rewind=True),
    "i4_plan_nothing_given": _plan,
    "i4_rewritten_states": _states,
    "i5_rewrite_summary": _summary,
    "i6_recent_jobs": _recent,
    "i7_job_health": _health,
    "i7_failed_jobs": lambda s, d: I.failed_jobs(_texts(s, d), CLOCK, 72),
    "i8_merge_tags": _merge,
    "i9_tag_plan": _tags,
    "i10_schedule_report": _schedules,
    "i11_definition_report": _definitions,
    "i12_connection_change_plan": _changes,
    "i13_ingest_roster": _roster,
    "u2_resolve_ids": _resolve,
    "u3_filter_users": _filter,
    "u4_group_change_plan": _group_plan,
    "u5_user_roster": _user_roster,
    "u5_group_roster": _member_roster,
}


def _plan_sql(to: str | None, rewind: bool, xid: str, select: str) -> str:
    moves = "FALSE" if to is None else f"form <= 3 AND ({'day >= ' + to if rewind else 'TRUE'})"
    stay = "skip:date" if to is None else "skip:advance"
    to = to or "DATE '2000-01-01'"
    return with_fx("fx_cursor", "").rstrip() + f"""
, c AS (SELECT *, {moves} AS moves, strftime({to}, '%Y-%m-%d') AS dash, strftime({to}, '%Y%m%d') AS flat,
               CASE WHEN form = 5 AND value <> 'n/a' THEN CAST(value AS BIGINT) END AS xid FROM fx_cursor),
plan AS (
  SELECT connection_id, namespace, stream, 'cursor' AS key, value AS old,
         CASE WHEN NOT moves THEN value WHEN form = 1 THEN concat(flat, substr(value, 9)) ELSE concat(dash, substr(value, 11)) END AS new,
         CASE WHEN form = 4 THEN 'skip:opaque' WHEN moves THEN 'rewrite' ELSE '{stay}' END AS action FROM c WHERE form <> 5
  UNION ALL
  SELECT connection_id, namespace, stream, 'cursor_record_count', CAST(record_count AS VARCHAR),
         CASE WHEN moves THEN '0' ELSE CAST(record_count AS VARCHAR) END,
         CASE WHEN moves AND record_count <> 0 THEN 'reset:count' ELSE 'skip:opaque' END FROM c WHERE form <> 5
  UNION ALL {xid})
{select}"""


_XID_HALF = """SELECT connection_id, namespace, stream, 'xmin', value,
   CASE WHEN xid IS NULL THEN value ELSE CAST(CAST(round_even(xid * 0.5::DOUBLE, 0) AS BIGINT) AS VARCHAR) END,
   CASE WHEN xid IS NULL THEN 'skip:xmin' ELSE 'rewrite:xmin' END FROM c WHERE form = 5"""
_XID_REWIND = """SELECT connection_id, namespace, stream, 'xmin', value,
   CASE WHEN xid >= 9000000 THEN '9000000' ELSE value END,
   CASE WHEN xid IS NULL THEN 'skip:xmin' WHEN xid < 9000000 THEN 'skip:advance' ELSE 'rewrite:xmin' END FROM c WHERE form = 5"""
_XID_NONE = "SELECT connection_id, namespace, stream, 'xmin', value, value, 'skip:xmin' FROM c WHERE form = 5"
_T = "DATE '1997-06-01'"
_BUSY = """SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e
  WHERE rn <= 5 AND event_type IN ('view', 'signup', 'click') GROUP BY user_id"""
_USTATE = f"date_add(ts, INTERVAL 72 HOUR) >= {CLOCK_SQL} AND (event_id % 5 <> 0 OR (event_id % 10 = 0 AND event_id % 20 <> 0))"

ORACLE = {
    "i1_classify_cursors": with_fx("fx_cursor", """
SELECT connection_id, stream, value, CASE WHEN form <= 3 THEN 'date' WHEN form = 4 THEN 'opaque' ELSE 'xmin' END AS cursor_kind FROM fx_cursor"""),
    "i4_plan_rewrites": _plan_sql(_T, False, _XID_HALF, "SELECT * FROM plan"),
    "i4_plan_rewind_only": _plan_sql(_T, True, _XID_REWIND, "SELECT * FROM plan"),
    "i4_plan_nothing_given": _plan_sql(None, False, _XID_NONE, "SELECT * FROM plan"),
    "i4_rewritten_states": with_fx("fx_cursor", """
SELECT connection_id, stream, CASE form WHEN 1 THEN '19970601' WHEN 5 THEN NULL ELSE concat('1997-06-01', substr(value, 11)) END AS cursor,
       CASE WHEN form <> 5 THEN '0' END AS record_count, CASE WHEN form = 5 THEN '77' END AS xid, CASE WHEN form = 5 THEN '77' END AS raw,
       CASE WHEN form = 5 THEN 'xmin' END AS state_type
FROM fx_cursor WHERE (form <= 3 AND day >= DATE '1997-06-01') OR (form = 5 AND value <> 'n/a' AND TRY_CAST(value AS BIGINT) >= 77)"""),
    "i5_rewrite_summary": _plan_sql(_T, False, _XID_HALF, f"""
SELECT CAST(count(*) FILTER (WHERE NOT busy) AS BIGINT) AS cursors, count(DISTINCT connection_id) FILTER (WHERE NOT busy) AS connections,
       CAST(count(*) FILTER (WHERE busy) AS BIGINT) AS busy_cursors, count(DISTINCT connection_id) FILTER (WHERE busy) AS busy_connections
FROM (SELECT *, connection_id IN ({_BUSY}) AS busy FROM plan WHERE starts_with(action, 'rewrite')) p"""),
    "i6_recent_jobs": with_fx("fx_jobs", """
SELECT * FROM fx_jobs WHERE status = 'failed' AND job_type = 'sync' ORDER BY start_time DESC, job_id DESC LIMIT 40"""),
    "i7_job_health": f"""
SELECT CASE WHEN event_id % 2 = 0 THEN 'sync' ELSE 'refresh' END AS job_type, count(*) AS jobs,
       count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type IN ('view', 'signup')) AS running
FROM events WHERE {_USTATE} GROUP BY 1""",
    "i7_failed_jobs": f"SELECT event_id AS job_id, user_id AS connection_id FROM events WHERE {_USTATE} AND event_type = 'error'",
    "i8_merge_tags": """
WITH t AS (
  SELECT o_orderkey AS k, 1 AS pos, CAST(o_orderkey % 3 AS VARCHAR) AS id, 'a' AS name FROM orders
  UNION ALL SELECT o_orderkey, 2, CAST(o_orderkey % 4 AS VARCHAR), 'b' FROM orders
  UNION ALL SELECT o_orderkey, 3, CAST(o_custkey % 4 AS VARCHAR), 'c' FROM orders WHERE o_custkey % 5 <> 0
  UNION ALL SELECT o_orderkey, 4, CAST(o_orderkey % 3 AS VARCHAR), 'd' FROM orders WHERE o_custkey % 5 <> 0),
m AS (SELECT k, id, min(pos) AS first, max_by(name, pos) AS name FROM t GROUP BY 1, 2)
SELECT k AS connection_id, string_agg(concat(id, '=', name), ',' ORDER BY first) AS tags FROM m GROUP BY 1""",
    "i9_tag_plan": """
WITH w AS (SELECT DISTINCT CAST(floor(p_partkey / 20) AS BIGINT) AS workspace_id, concat(p_type, '/', p_brand) AS name FROM part),
h AS (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS workspace_id, concat(p_type, '/', p_brand) AS name, max(p_partkey) AS tag_id
      FROM part WHERE p_size > 25 GROUP BY 1, 2)
SELECT workspace_id, name, tag_id, CASE WHEN tag_id IS NULL THEN 'create' ELSE 'use' END AS action FROM w LEFT JOIN h USING (workspace_id, name)""",
    "i10_schedule_report": """
WITH c AS (
  SELECT c_custkey AS k, CAST(c_custkey % 70 AS VARCHAR) AS m, CAST(c_custkey % 24 AS VARCHAR) AS h, c_custkey % 8 AS f FROM customer),
e AS (
  SELECT *, CASE f WHEN 0 THEN concat('0 ', m, ' ', h, ' * * ?') WHEN 1 THEN concat('0 ', m, ' ', h, ' ? * MON-FRI')
    WHEN 2 THEN concat(CASE WHEN k % 40 = 10 THEN repeat(concat(m, ','), 2500) ELSE '' END, m, ' */6 1,15 * *') WHEN 3 THEN concat('0 ', m, ' ', h, ' * * ? Mars/Base')
    WHEN 4 THEN concat('0 ', m, ' ', h, ' L * ? 2030') WHEN 5 THEN concat(m, ' ', h) END AS expression,
    CASE WHEN f <= 5 THEN 'cron' WHEN f = 6 THEN CASE WHEN k % 16 = 6 THEN 'basic' ELSE 'manual' END END AS schedule_type,
    CASE WHEN k % 16 = 1 THEN 'Asia/Tokyo' WHEN f = 1 THEN 'Europe/Paris' WHEN f = 4 THEN 'UTC' END AS time_zone FROM c)
SELECT k AS connection_id, schedule_type, expression, time_zone,
       CASE WHEN f <= 5 THEN CAST(len(string_split(expression, ' ')) AS INTEGER) END AS fields,
       CASE WHEN f <= 5 THEN f NOT IN (3, 5) AND k % 70 < 60 END AS valid,
       CASE WHEN f <= 5 THEN concat('cron:', expression, CASE WHEN time_zone IS NOT NULL THEN concat(' ', time_zone) ELSE '' END)
            WHEN k % 16 = 6 THEN concat('basic:Every ', h, ' HOURS') WHEN f = 6 THEN 'manual' ELSE 'N/A' END AS display FROM e""",
    "i11_definition_report": """
SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('d', CAST(p_partkey AS VARCHAR)) ELSE concat('s', CAST(p_partkey AS VARCHAR)) END AS definition_id,
       p_name AS name, concat('img/', lower(p_type), CASE WHEN p_partkey % 3 <> 0 THEN concat(':', CAST(p_size AS VARCHAR)) ELSE '' END) AS image FROM part""",
    "i12_connection_change_plan": """
WITH c AS (
  SELECT o_orderkey AS k, o_custkey AS u, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey % 5 AS VARCHAR) ELSE '' END AS have,
         coalesce(CAST(n_regionkey AS VARCHAR), '') AS extra, o_orderstatus AS st
  FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30 WHERE o_custkey % 3 = 1),
m AS (SELECT *, CASE WHEN extra = '' OR extra = have THEN have WHEN have = '' THEN extra ELSE concat(have, ',', extra) END AS tag_ids FROM c),
f AS (SELECT *, concat_ws(',', CASE WHEN st <> 'F' THEN 'status' END, CASE WHEN k % 4 = 0 THEN 'prefix' END,
         CASE WHEN k % 6 <> 0 THEN 'schedule' END, CASE WHEN tag_ids <> have THEN 'tags' END) AS changed_fields FROM m)
SELECT k AS connection_id, changed_fields, changed_fields = '' AS unchanged, tag_ids FROM f""",
    "i13_ingest_roster": """
SELECT s_suppkey AS item_id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'postgres' ELSE 'N/A' END AS connector, s_nationkey AS workspace_id,
       (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS connections
FROM supplier WHERE s_acctbal >= 0 AND s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)""",
    "u2_resolve_ids": """
SELECT name, n_nationkey AS id, n_nationkey IS NULL AS missing
FROM (SELECT DISTINCT concat('Nation_', CAST(c_nationkey + c_custkey % 4 AS VARCHAR)) AS name FROM customer) w
LEFT JOIN nation ON lower(n_name) = lower(name)""",
    "u3_filter_users": with_fx("fx_bi_users", """
SELECT user_id, 'exact' AS mode FROM fx_bi_users WHERE list_contains(role_ids, 2) AND list_contains(role_ids, 7) AND len(list_filter(role_ids, lambda x: x NOT IN (2, 7))) = 0
UNION ALL SELECT user_id, 'subset' FROM fx_bi_users WHERE len(role_ids) > 0 AND len(list_filter(role_ids, lambda x: x NOT IN (2, 7))) = 0
UNION ALL SELECT user_id, 'any' FROM fx_bi_users WHERE list_contains(role_ids, 2) OR list_contains(role_ids, 7)
UNION ALL SELECT user_id, 'email' FROM fx_bi_users WHERE user_id IN (7, 8)"""),
    "u4_group_change_plan": with_fx("fx_bi_users", """
, g AS (SELECT user_id, list_sort(list_distinct(group_ids)) AS b, list_sort(list_distinct(list_filter(list_concat(group_ids, [1, 5]), lambda x: x <> 0))) AS a FROM fx_bi_users),
p AS (SELECT user_id, 'change' AS mode, b, a FROM g UNION ALL SELECT user_id, 'set', b, [2] FROM g UNION ALL SELECT user_id, 'clear', b, CAST([] AS BIGINT[]) FROM g)
SELECT user_id, mode, array_to_string(b, ',') AS before, array_to_string(a, ',') AS after FROM p WHERE a <> b"""),
    "u5_user_roster": with_fx("fx_bi_users", """
SELECT user_id, username, concat_ws(' ', first_name, last_name) AS full_name, email, active,
       coalesce((SELECT string_agg(coalesce(r_name, CAST(r.id AS VARCHAR)), ', ' ORDER BY r.i)
         FROM (SELECT unnest(role_ids) AS id, unnest(range(len(role_ids))) AS i) r LEFT JOIN region ON r_regionkey = r.id), '') AS roles
FROM fx_bi_users"""),
    "u5_group_roster": with_fx("fx_bi_users", """
SELECT CAST(r_regionkey AS BIGINT) AS group_id, r_name AS group_name, count(user_id) AS users
FROM region LEFT JOIN (SELECT DISTINCT user_id, unnest(group_ids) AS g FROM fx_bi_users) u ON g = r_regionkey GROUP BY 1, 2"""),
}
