"""Metrics, health, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate.operators import health as H
from estate.operators import ingest as I
from estate.operators import metrics as M
from estate.operators import querylog as Q
from estate.operators import storage as S
from estate.session import scratch_path
from estate.sources import audit, pages, sinks, snapshot
from estate.streaming import monitors
from estate_queries import fixtures as X
from estate_queries.fixtures import CLOCK, CLOCK_SQL, with_fx
from estate_queries.ingest import TO, _plan, _state, _texts, _users
from estate_queries.storage import ORACLE as storage_oracle

DAYS = 24 * 10


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _expected(spark, d):
    """Every scope and metric that ever reported, and one idle scope per nation."""
    seen = X.metric_points(spark, d).select("scope", "metric")
    idle = X.table(spark, d, "nation").select(
        F.lower("n_name").alias("scope"), F.lit("CPUUtilization").alias("metric"))
    return seen.unionByName(idle)


def _summary(spark, d):
    return M.metric_summary(X.metric_points(spark, d), CLOCK, DAYS, 3600, _expected(spark, d))


def _thresholds(spark, d):
    scaled = X.metric_points(spark, d).withColumn(
        "value", F.when(F.col("metric").startswith("Free"), F.col("value") * 50000000)
        .when(F.col("metric") == "DatabaseConnections", F.col("value") * 5)
        .otherwise(F.col("value") * 1.0003))
    out = M.threshold_state(M.metric_summary(scaled, CLOCK, DAYS, 86400))
    return _rounded(out.select("scope", "metric", "latest", "state", "shown"), "latest")


def _series(spark, d):
    return _rounded(M.metric_series(X.metric_points(spark, d), 6 * 3600), "value")


def _dims(spark, d):
    key = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    dims = F.map_filter(F.create_map(
        F.lit("Workgroup"), F.when(key % 7 != 0, X.name("w", X.half("o_custkey", 20))),
        F.lit("DatabaseName"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).otherwise(none),
        F.lit("LatencyBand"), F.when(key % 3 == 0, F.col("o_orderstatus")).otherwise(none)),
        lambda k, v: v.isNotNull())
    series = X.table(spark, d, "orders").select(
        key.alias("series_id"), F.when(key % 2 == 0, "QueryDuration").otherwise("ComputeSeconds").alias("metric"),
        dims.alias("dims"))
    best = M.pick_dimensions(series, ["Workgroup"])
    return best.select("metric", F.col("base.Workgroup").alias("workgroup"), "candidates", "series_id",
                       F.size("dims").alias("size"))


def _instances(spark, d):
    key = F.col("s_suppkey")
    return M.instance_roster(X.table(spark, d, "supplier").select(
        F.col("s_name").alias("identifier"), X.name("db.r", F.col("s_nationkey")).alias("class"),
        F.lit("postgres").alias("engine"), F.when(key % 3 != 0, X.s(F.col("s_nationkey") + 1)).alias("engine_version"),
        F.when(F.col("s_acctbal") > 0, "available").otherwise("stopped").alias("status"),
        F.when(key % 4 != 0, key * 10).alias("allocated_storage"), F.when(key % 5 != 0, key % 2 == 0).alias("multi_az")))


def _health(spark, d):
    def databases():
        targets = X.relations(spark, d).select("target").distinct().withColumn(
            "has_sessions", F.col("target") != "wh2")
        return Q.long_running_counts(X.query_log(spark, d), targets, CLOCK)

    def ingestion():
        return I.job_health(_texts(spark, d), CLOCK, 24).select(F.lit("jobs").alias("target"), "*")

    def storage():
        cpu = M.metric_summary(X.metric_points(spark, d), CLOCK, DAYS, 3600)
        wanted = cpu.where(F.col("metric").isin("CPUUtilization", "FreeStorageSpace"))
        return wanted.groupBy(F.col("scope").alias("target")).agg(
            F.max(F.when(F.col("metric") == "CPUUtilization", F.col("latest"))).alias("cpu"),
            F.max(F.when(F.col("metric") == "FreeStorageSpace", F.col("latest"))).alias("storage"))

    def broken():
        return X.table(spark, d, "orders").select("no_such_column")

    def torn():
        gone = F.when(F.col("o_orderkey") > 0, F.raise_error(F.lit("the source went away")).cast("double"))
        return X.table(spark, d, "orders").select(F.lit("lake").alias("target"), gone.alias("orders"))

    out = H.health(spark, [("databases", databases), ("ingestion", ingestion), ("bi", broken), ("lake", torn),
                           ("cloud", storage)])
    return _rounded(out.withColumn("message", F.substring_index("message", "]", 1)), "value")


def _coverage(spark, d):
    kinds = F.array(*map(F.lit, H.ENGINES))
    targets = X.table(spark, d, "supplier").select(
        X.name("wh", "s_suppkey").alias("target"), kinds[F.col("s_nationkey") % 3].alias("engine"))
    return H.coverage(targets, H.capability_table(spark)).select("target", "engine", "section")


REVENUE = """
SELECT n_name, o_orderpriority, count(DISTINCT o_orderkey) AS orders, sum(l_quantity) AS quantity,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag <> 'R'
GROUP BY n_name, o_orderpriority
HAVING count(DISTINCT o_orderkey) > 1"""
WINDOWED = """
WITH ranked AS (
  SELECT c_mktsegment, c_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS spent,
         row_number() OVER (PARTITION BY c_mktsegment
                            ORDER BY sum(CAST(o_totalprice AS DECIMAL(18, 2))) DESC, c_custkey) AS place
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey)
SELECT c_mktsegment, c_custkey, CAST(spent AS DOUBLE) AS spent, CAST(place AS INTEGER) AS place
FROM ranked WHERE place <= 10"""


def _adhoc(sql, *names):
    def run(spark, d):
        return snapshot.run_sql(spark, sql, {n: X.table(spark, d, n) for n in names})

    return run


def _snapshot(spark, d):
    path = scratch_path(spark, "snapshot")
    X.relations(spark, d).write.parquet(path)
    return snapshot.read_snapshot(spark, "relations", path)


def _targets(spark, d):
    """Three warehouses: one without sizes, one whose report cannot be built."""
    rel = X.relations(spark, d)
    pick = lambda t: S.stored_relations(rel).where(F.col("target") == t)
    return snapshot.union_targets(spark, {
        "wh0": pick("wh0").select("relation_id", "size_bytes"),
        "wh1": lambda: pick("wh1").select("relation_id", "no_such_size"),
        "wh2": lambda: pick("wh2").select("relation_id", "row_estimate"),
    })


def _target_report(spark, d):
    rows, errors = _targets(spark, d)
    found = rows.groupBy("target").agg(
        F.count("*").alias("relations"), F.count("size_bytes").alias("sized"), F.count("row_estimate").alias("estimated"))
    told = errors.withColumn("message", F.substring_index("message", "]", 1))
    return found.join(told, "target", "full")


def _page_lines(spark, d):
    """Listing pages as services wrap them, one item per conversation turn."""
    item = F.to_json(F.struct(
        F.when(F.col("turn") % 2 == 0, F.col("conv_id")).alias("connectionId"),
        F.when(F.col("turn") % 2 == 1, F.col("conv_id")).alias("connection_id"), "turn", "role"))
    form = F.col("conv_id") % 7
    wrap = (
        F.when(form == 0, F.concat(F.lit('{"data":['), item, F.lit("]}")))
        .when(form == 1, F.concat(F.lit('{"result":['), item, F.lit(',{"turn":-1}]}')))
        .when(form == 2, F.concat(F.lit('{"result":{"data":['), item, F.lit("]}}")))
        .when(form == 3, F.concat(F.lit('{"tags":['), item, F.lit("]}")))
        .when(form == 4, F.concat(F.lit("["), item, F.lit("]")))
        .when(form == 5, F.concat(F.lit('{"data":['), item))
        .otherwise(F.lit('{"data":[]}')))
    return X.table(spark, d, "conversations").select(wrap.alias("value"))


def _pages(spark, d):
    path = scratch_path(spark, "pages")
    _page_lines(spark, d).write.text(path)
    return pages.read_pages(spark, path).select(
        pages.field("item", "connectionId", "connection_id", as_type="bigint").alias("connection_id"),
        pages.field("item", "turn", as_type="bigint").alias("turn"), pages.field("item", "role").alias("role"))


def _missing(spark, d):
    key = F.col("o_orderkey")
    res = X.half("o_orderkey", 6)
    # Every other page is there.
    listing = X.table(spark, d, "orders").select(
        X.name("res", res).alias("resource"), (key % 6 * 2).alias("page"), F.lit(10).alias("page_size"),
        F.when(res % 2 == 0, res % 70).alias("count"), F.when(res % 3 == 0, F.lit(45)).alias("total"),
        F.when(res % 5 == 0, res % 8).alias("total_pages"))
    return pages.missing_pages(listing)


def _log_lines(spark, d):
    log = X.rename_log(spark, d)
    number = F.col("old_name").substr(2, 9).cast("bigint")
    record = F.to_json(F.struct(
        F.when(number % 5 != 0, F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon").alias("generated_at"),
        F.col("dry_run"), F.lit("test").alias("source"),
        F.array(F.struct(F.col("target").alias("database"), F.col("schema_name").alias("schema"), "old_name",
                         F.when(number % 7 != 0, F.col("new_name")).alias("new_name"), F.lit("table").alias("kind")))
        .alias("renames")))
    return log.select(F.when(number % 11 == 0, F.substring(record, 1, 25)).when(number % 11 == 1, F.lit("[7]"))
                      .otherwise(record).alias("value"))


def _log(spark, d):
    path = scratch_path(spark, "renames")
    _log_lines(spark, d).write.text(path)
    return audit.read_rename_log(spark, path)


def _audit(spark, d):
    path = scratch_path(spark, "audit")
    plan = S.top_relations(X.relations(spark, d), "dev_", 20, ("wh2",)).select("target", "schema_name", "relation_name")
    audit.write_audit(plan, path, CLOCK, dry_run=True)
    audit.write_audit(plan.where("target <> 'wh0'"), path, CLOCK.replace(day=30), dry_run=False)
    rows = spark.read.schema("target string, schema_name string, relation_name string, run_ts timestamp_ntz, "
                             "dry_run boolean, run_date date").json(path)
    return rows


def _export(spark, d, fmt):
    path = scratch_path(spark, "export")
    df = X.table(spark, d, "conversations").select("conv_id", "turn", "role", F.upper("role").alias("note"))
    sinks.export(df, path, fmt)
    reader = spark.read.schema(df.schema)
    return reader.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else reader.json(path)


def _flatten(spark, d):
    users = _users(spark, d).select(
        "user_id", "first_name", "active", "group_ids", F.struct("user_id", "last_name").alias("about"))
    other = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("supplier"))
    return sinks.flatten_for_export(users.unionByName(other, allowMissingColumns=True))


def _backup(spark, d):
    path = scratch_path(spark, "backup")
    state = _state(spark, d)
    audit.backup_state(state, _plan(spark, d, to=TO, only_rewind=True), path)
    return spark.read.schema(state.schema).json(path).select("connection_id", "stream", "namespace")


def _optional(spark, d):
    schema = "c_custkey bigint, c_name string"
    have, known = snapshot.read_optional(spark, f"{d}/customer.parquet", schema)
    lost, unknown = snapshot.read_optional(spark, f"{d}/no_such_view.parquet", schema)
    count = lambda df, label, flag: df.agg(F.count("*").alias("n")).select(
        F.lit(label).alias("source"), F.lit(flag).alias("available"), F.when(F.lit(flag), F.col("n")).alias("rows"))
    return count(have, "customer", known).unionByName(count(lost, "no_such_view", unknown))


def _stream(spark, d, name="events"):
    schema = X.table(spark, d, name).schema
    # A pattern, as a stream takes a single file only that way.
    return monitors.read_stream(spark, f"{d}/{name}.parquet*", schema)


def _metric_stream(spark, d):
    kind = F.col("event_type")
    points = _stream(spark, d).select(X.name("workgroup:", F.col("user_id") % 5).alias("scope"),
                                      kind.alias("metric"), "ts", "value")
    return _rounded(monitors.run_available(monitors.metric_stream(points), scratch_path(spark, "metrics")), "avg")


def _alert_stream(spark, d):
    kind = F.col("event_type")
    log = _stream(spark, d).select(
        X.s("event_id").alias("query_id"), X.name("u", "user_id").alias("user_name"),
        F.when(kind == "error", "Failed").when(kind == "view", "running").otherwise("success").alias("status"),
        F.col("ts").alias("start_time"), F.when(kind != "view", F.floor("value").cast("bigint")).alias("duration_s"))
    alerts = monitors.alert_stream(log, CLOCK, min_s=60, hours=48)
    return monitors.run_available(alerts, scratch_path(spark, "alerts")).select("query_id", "user_name", "elapsed_s", "is_live")


def _outlasting_stream(spark, d):
    """Views are handed in live; the end row of every third one follows."""
    kind, key = F.col("event_type"), F.col("event_id")
    done = F.struct(F.lit("success").alias("status"), F.floor("value").cast("bigint").alias("duration_s"))
    live = F.struct(F.lit("running").alias("status"), F.lit(None).cast("bigint").alias("duration_s"))
    rows = F.when(kind != "view", F.array(done)).when(key % 3 == 0, F.array(live, done)).otherwise(F.array(live))
    log = _stream(spark, d).select(
        X.s(key).alias("query_id"), X.name("u", "user_id").alias("user_name"), F.col("ts").alias("start_time"),
        F.explode(rows).alias("row")).select("query_id", "user_name", "start_time", "row.*")
    late = monitors.outlasting_stream(log, min_s=60, delay="1 hour")
    return monitors.run_available(late, scratch_path(spark, "outlasting")).select(
        "query_id", "user_name", "start_time", "elapsed_s")


def _job_stream(spark, d):
    kind = F.col("event_type")
    jobs = _stream(spark, d).select(
        F.col("ts").alias("start_time"),
        F.when(kind == "error", "failed").when(kind == "view", "running").otherwise("succeeded").alias("status"))
    return monitors.run_available(monitors.job_health_stream(jobs), scratch_path(spark, "jobs"))


def _adhoc_page(spark, d):
    tables = {n: X.table(spark, d, n) for n in ("customer", "orders")}
    return snapshot.run_sql_page(spark, BY_CUSTOMER, tables, ["c_custkey"], limit=15, number=2)


BY_CUSTOMER = """
SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""

QUERIES = {
    "a1_adhoc_page": _adhoc_page,
    "a1_adhoc_revenue": _adhoc(REVENUE, "customer", "orders", "lineitem", "nation"),
    "a1_adhoc_windowed": _adhoc(WINDOWED, "customer", "orders"),
    "a2_read_snapshot": _snapshot,
    "a3_union_targets": lambda s, d: _targets(s, d)[0],
    "a3_target_report": _target_report,
    "a5_read_pages": _pages,
    "a6_missing_pages": _missing,
    "a7_read_rename_log": _log,
    "a8_write_audit": _audit,
    "a9_export_csv": lambda s, d: _export(s, d, "csv"),
    "a9_export_json": lambda s, d: _export(s, d, "json"),
    "a10_flatten_for_export": _flatten,
    "a11_backup_state": _backup,
    "a12_read_optional": _optional,
    "m1_metric_summary": lambda s, d: _rounded(_summary(s, d), "latest", "average"),
    "m2_threshold_state": _thresholds,
    "m3_metric_series": _series,
    "m4_pick_dimensions": _dims,
    "m6_instance_roster": _instances,
    "k1_health": _health,
    "k3_coverage": _coverage,
    "s1_metric_stream": _metric_stream,
    "s2_alert_stream": _alert_stream,
    "s2_outlasting_stream": _outlasting_stream,
    "s3_job_health_stream": _job_stream,
}


def _metric_sql(points: str, period: int, body: str, days: int = 10) -> str:
    return with_fx("fx_metric_points", "").rstrip() + f"""
, pts AS ({points}),
per AS (
  SELECT scope, metric, CAST(floor(epoch(ts) / {period}) AS BIGINT) AS b, avg(value) AS a, min(value) AS lo, max(value) AS hi
  FROM pts WHERE ts >= {CLOCK_SQL} - INTERVAL {days} DAY AND ts < {CLOCK_SQL} GROUP BY 1, 2, 3),
summary AS (
  SELECT scope, metric, round(max_by(a, b), 6) AS latest, round(avg(a), 6) AS average, min(lo) AS min, max(hi) AS max FROM per GROUP BY 1, 2)
{body}"""


_SCALED = """SELECT scope, metric, ts, CASE WHEN starts_with(metric, 'Free') THEN value * 50000000
   WHEN metric = 'DatabaseConnections' THEN value * 5 ELSE value * 1.0003::DOUBLE END AS value FROM fx_metric_points"""
_PLAIN = "SELECT * FROM fx_metric_points"
_LACK_SQL = " UNION ALL ".join(f"SELECT '{e}' AS engine, '{s}' AS section" for e, s in sorted(H.LACKS))

ORACLE = {
    "a1_adhoc_page": f"""
WITH q AS ({BY_CUSTOMER})
SELECT *, (SELECT count(*) FROM q) > 30 AS has_more FROM q ORDER BY c_custkey LIMIT 15 OFFSET 15""",
    "a1_adhoc_revenue": REVENUE,
    "a1_adhoc_windowed": WINDOWED,
    "a2_read_snapshot": with_fx("fx_relations", "SELECT * FROM fx_relations"),
    "a3_union_targets": with_fx("fx_relations", """
SELECT relation_id, target, CASE WHEN target = 'wh0' THEN size_bytes END AS size_bytes,
       CASE WHEN target = 'wh2' AND row_estimate >= 0 THEN row_estimate END AS row_estimate
FROM fx_relations WHERE relkind IN ('r', 'p', 'm') AND target <> 'wh1'"""),
    "a3_target_report": with_fx("fx_relations", """
SELECT target, CASE WHEN target <> 'wh1' THEN count(*) END AS relations,
       CASE target WHEN 'wh0' THEN count(size_bytes) WHEN 'wh2' THEN 0 END AS sized,
       CASE target WHEN 'wh0' THEN 0 WHEN 'wh2' THEN count(*) FILTER (WHERE row_estimate >= 0) END AS estimated,
       CASE WHEN target = 'wh1' THEN 'AnalysisException' END AS error,
       CASE WHEN target = 'wh1' THEN '[UNRESOLVED_COLUMN.WITH_SUGGESTION' END AS message
FROM fx_relations WHERE relkind IN ('r', 'p', 'm') GROUP BY target"""),
    "a5_read_pages": """
SELECT conv_id AS connection_id, turn, role FROM conversations WHERE conv_id % 7 <= 4
UNION ALL SELECT NULL, -1, NULL FROM conversations WHERE conv_id % 7 = 1""",
    "a6_missing_pages": """
WITH l AS (
  SELECT DISTINCT CAST(floor(o_orderkey / 6) AS BIGINT) AS r, o_orderkey % 6 * 2 AS page FROM orders),
n AS (
  SELECT DISTINCT r, CASE WHEN r % 5 = 0 THEN r % 8 WHEN r % 2 = 0 THEN CAST(ceil((r % 70) / 10) AS BIGINT) WHEN r % 3 = 0 THEN 5 END AS need FROM l)
SELECT concat('res', CAST(n.r AS VARCHAR)) AS resource, p.page FROM n, LATERAL (SELECT unnest(range(0, need)) AS page) p
WHERE need > 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.r = n.r AND l.page = p.page)""",
    "a7_read_rename_log": with_fx("fx_rename_log", """
SELECT target, schema_name, old_name, new_name, generated_at, FALSE AS dry_run
FROM (SELECT *, CAST(substr(old_name, 2) AS BIGINT) AS n FROM fx_rename_log) l
WHERE NOT dry_run AND n % 5 <> 0 AND n % 7 <> 0 AND n % 11 > 1"""),
    "a8_write_audit": storage_oracle["c1_top_relations"].replace(
        "SELECT target, rank, schema_name, relation_name, relkind, row_estimate, size_bytes FROM top WHERE rank <= 20", f"""
SELECT target, schema_name, relation_name, {CLOCK_SQL} AS run_ts, TRUE AS dry_run, DATE '2024-01-31' AS run_date FROM top WHERE rank <= 20
UNION ALL SELECT target, schema_name, relation_name, TIMESTAMP '2024-01-30 00:00:00', FALSE, DATE '2024-01-30'
FROM top WHERE rank <= 20 AND target <> 'wh0'"""),
    "a9_export_csv": "SELECT conv_id, turn, role, upper(role) AS note FROM conversations",
    "a9_export_json": "SELECT conv_id, turn, role, upper(role) AS note FROM conversations",
    "a10_flatten_for_export": with_fx("fx_bi_users", """
SELECT CAST(user_id AS VARCHAR) AS user_id, coalesce(first_name, 'N/A') AS first_name, CAST(active AS VARCHAR) AS active,
       concat('[', array_to_string(group_ids, ','), ']') AS group_ids,
       concat('{"user_id":', CAST(user_id AS VARCHAR), CASE WHEN last_name IS NULL THEN '' ELSE concat(',"last_name":"', last_name, '"') END, '}') AS about,
       'N/A' AS supplier FROM fx_bi_users
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'N/A', 'N/A', 'N/A', 'N/A', s_name FROM supplier"""),
    "a11_backup_state": with_fx("fx_cursor", """
SELECT connection_id, stream, namespace FROM fx_cursor
WHERE connection_id IN (SELECT connection_id FROM fx_cursor WHERE form <= 3 AND day >= DATE '1997-06-01')"""),
    "a12_read_optional": """
SELECT 'customer' AS source, TRUE AS available, count(*) AS rows FROM customer UNION ALL SELECT 'no_such_view', FALSE, NULL""",
    "m1_metric_summary": _metric_sql(_PLAIN, 3600, """
SELECT e.scope, e.metric, latest, average, min, max
FROM (SELECT scope, metric FROM fx_metric_points UNION SELECT lower(n_name), 'CPUUtilization' FROM nation) e
LEFT JOIN summary s ON s.scope = e.scope AND s.metric = e.metric"""),
    "m2_threshold_state": _metric_sql(_SCALED, 86400, """
SELECT scope, metric, latest, CASE metric
    WHEN 'CPUUtilization' THEN CASE WHEN latest >= 90 THEN 'crit' WHEN latest >= 70 THEN 'warn' ELSE 'ok' END
    WHEN 'DatabaseConnections' THEN CASE WHEN latest >= 400 THEN 'crit' WHEN latest >= 200 THEN 'warn' ELSE 'ok' END
    WHEN 'FreeableMemory' THEN CASE WHEN latest < 536870912 THEN 'crit' WHEN latest < 1073741824 THEN 'warn' ELSE 'ok' END
    WHEN 'FreeStorageSpace' THEN CASE WHEN latest < 5368709120 THEN 'crit' WHEN latest < 21474836480 THEN 'warn' ELSE 'ok' END
    ELSE CASE WHEN latest < 20 THEN 'crit' WHEN latest < 40 THEN 'warn' ELSE 'ok' END END AS state,
  CASE WHEN starts_with(metric, 'Free') THEN printf('%.2f GB', latest / 1073741824) WHEN metric = 'DatabaseConnections' THEN printf('%.2f', latest)
    ELSE concat(printf('%.2f', latest), '%') END AS shown FROM summary"""),
    "m3_metric_series": _metric_sql(_PLAIN, 21600, """
, v AS (
  SELECT scope, metric, make_timestamp(b * 21600 * 1000000) AS start, CASE WHEN starts_with(metric, 'Free') THEN a / 1073741824
    WHEN metric IN ('CPUUtilization', 'EBSIOBalance%') THEN least(a, 100.0) ELSE a END AS raw FROM per),
w AS (
  SELECT *, row_number() OVER (PARTITION BY scope, metric ORDER BY raw, start) AS lo,
         row_number() OVER (PARTITION BY scope, metric ORDER BY raw DESC, start) AS hi FROM v)
SELECT scope, metric, start, round(raw, 6) AS value, lo = 1 AS is_min, hi = 1 AS is_max FROM w""", days=3650),
    "m4_pick_dimensions": """
WITH s AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'QueryDuration' ELSE 'ComputeSeconds' END AS metric,
         concat('w', CAST(CAST(floor(o_custkey / 20) AS BIGINT) AS VARCHAR)) AS workgroup,
         1 + CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS size
  FROM orders WHERE o_orderkey % 7 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, workgroup ORDER BY size, id) AS rn, count(*) OVER (PARTITION BY metric, workgroup) AS candidates FROM s)
SELECT metric, workgroup, candidates, id AS series_id, CAST(size AS INTEGER) AS size FROM r WHERE rn = 1""",
    "m6_instance_roster": """
SELECT s_name AS identifier, concat('db.r', CAST(s_nationkey AS VARCHAR)) AS class,
       CASE WHEN s_suppkey % 3 <> 0 THEN concat('postgres ', CAST(s_nationkey + 1 AS VARCHAR)) ELSE 'postgres' END AS engine,
       CASE WHEN s_acctbal > 0 THEN 'available' ELSE 'stopped' END AS status, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 10 END AS storage_gb,
       CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 2 = 0 ELSE FALSE END AS multi_az FROM supplier""",
    "k1_health": _metric_sql(_PLAIN, 3600, f"""
, rows AS (
  SELECT 1 AS position, 'databases' AS system, t.target, 'long_running' AS figure, CASE WHEN t.target <> 'wh2' THEN CAST(coalesce(n, 0) AS DOUBLE) END AS value
  FROM (SELECT DISTINCT concat('wh', CAST(p_partkey % 3 AS VARCHAR)) AS target FROM part) t
  LEFT JOIN (SELECT concat('wh', CAST(user_id % 3 AS VARCHAR)) AS target, count(*) AS n FROM events
             WHERE event_type IN ('view', 'signup') AND date_sub('second', ts, {CLOCK_SQL}) >= 60 GROUP BY 1) l ON l.target = t.target
  UNION ALL
  SELECT 2, 'ingestion', 'jobs', f.figure, CAST(CASE f.figure WHEN 'jobs' THEN count(*) WHEN 'failed' THEN count(*) FILTER (WHERE event_type = 'error')
         ELSE count(*) FILTER (WHERE event_type IN ('view', 'signup')) END AS DOUBLE)
  FROM events, (SELECT unnest(['jobs', 'failed', 'running']) AS figure) f
  WHERE ts >= {CLOCK_SQL} - INTERVAL 24 HOUR AND (event_id % 5 <> 0 OR (event_id % 10 = 0 AND event_id % 20 <> 0)) GROUP BY f.figure
  UNION ALL
  SELECT 5, 'cloud', s.scope, f.figure, max(CASE WHEN s.metric = f.metric THEN s.latest END)
  FROM summary s, (SELECT 'cpu' AS figure, 'CPUUtilization' AS metric UNION ALL SELECT 'storage', 'FreeStorageSpace') f
  WHERE s.metric IN ('CPUUtilization', 'FreeStorageSpace') GROUP BY s.scope, f.figure)
SELECT position, system, target, TRUE AS available, figure, value, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS message FROM rows
UNION ALL SELECT DISTINCT position, system, target, TRUE, 'reachable', 1.0, NULL, NULL FROM rows
UNION ALL SELECT 3, 'bi', NULL, FALSE, 'reachable', 0.0, 'AnalysisException', '[UNRESOLVED_COLUMN.WITH_SUGGESTION'
UNION ALL SELECT 4, 'lake', NULL, FALSE, 'reachable', 0.0, 'SparkRuntimeException', '[USER_RAISED_EXCEPTION'"""),
    "k3_coverage": f"""
SELECT concat('wh', CAST(s_suppkey AS VARCHAR)) AS target, l.engine, section
FROM supplier JOIN ({_LACK_SQL}) l ON l.engine = ['postgresql', 'redshift', 'duckdb'][s_nationkey % 3 + 1]""",
    "s1_metric_stream": """
SELECT * FROM (
  SELECT date_trunc('day', ts)::TIMESTAMP AS start, concat('workgroup:', CAST(user_id % 5 AS VARCHAR)) AS scope, event_type AS metric,
         count(*) AS points, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2, 3) w
WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "s2_alert_stream": f"""
SELECT query_id, user_name, elapsed_s, is_live FROM (
  SELECT CAST(event_id AS VARCHAR) AS query_id, concat('u', CAST(user_id AS VARCHAR)) AS user_name, event_type = 'view' AS is_live, ts, event_type,
         CASE WHEN event_type = 'view' THEN date_sub('second', ts, {CLOCK_SQL}) ELSE CAST(floor(value) AS BIGINT) END AS elapsed_s FROM events) e
WHERE (elapsed_s >= 60 AND (is_live OR ts >= {CLOCK_SQL} - INTERVAL 48 HOUR)) OR (event_type = 'error' AND ts >= {CLOCK_SQL} - INTERVAL 48 HOUR)""",
    "s2_outlasting_stream": """
WITH seen AS (
  SELECT max(ts) FILTER (WHERE event_type = 'view') AS last_start,
         max(ts + to_seconds(CAST(floor(value) AS BIGINT))) FILTER (WHERE event_type <> 'view' OR event_id % 3 = 0) AS last_end
  FROM events)
SELECT CAST(event_id AS VARCHAR) AS query_id, concat('u', CAST(user_id AS VARCHAR)) AS user_name, ts AS start_time,
       CAST(60 AS BIGINT) AS elapsed_s
FROM events, seen
WHERE event_type = 'view' AND NOT (event_id % 3 = 0 AND floor(value) >= 0 AND floor(value) < 60)
  AND ts + INTERVAL 60 SECOND < least(last_start, last_end) - INTERVAL 1 HOUR""",
    "s3_job_health_stream": """
WITH h AS (
  SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS jobs, count(*) FILTER (WHERE event_type = 'error') AS failed,
         count(*) FILTER (WHERE event_type = 'view') AS running FROM events GROUP BY 1)
SELECT start, CAST(sum(jobs) AS BIGINT) AS jobs, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(running) AS BIGINT) AS running
FROM (SELECT *, hour - to_hours(CAST(i AS INTEGER)) AS start FROM h, (SELECT unnest(range(0, 24)) AS i) o) x
WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY start""",
}
