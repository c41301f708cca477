"""Inputs derived from the given tables, once with the DataFrame API and once as SQL.

The two sides are written apart on purpose: a mistake in one shows as a mismatch.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed clock for every "now"; events end on 2024-01-30.
CLOCK = datetime(2024, 1, 31)
CLOCK_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def s(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def name(prefix: str, col: Column | str) -> Column:
    return F.concat(F.lit(prefix), s(col))


def half(col: str, by: int) -> Column:
    return F.floor(F.col(col) / by).cast("bigint")


def part_schema() -> Column:
    size = F.col("p_size")
    stem = (
        F.when(size <= 20, "dev_").when(size <= 30, "devx").when(size <= 40, "pg_").otherwise("prod_")
    )
    return F.concat(stem, F.lower("p_type"))


def part_target() -> Column:
    return name("wh", F.col("p_partkey") % 3)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation snapshot: wh2 reports no sizes, -1 rows means never analysed."""
    used = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("p_partkey"))
        .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    )
    key = F.col("p_partkey")
    ending = F.when(key % 11 == 0, "_deprecated").when(key % 13 == 0, "xdeprecated").otherwise("")
    kind = (
        F.when(key % 10 == 0, "v").when(key % 10 == 1, "m").when(key % 10 == 2, "p")
        .when(key % 10 == 3, "S").otherwise("r")
    )
    rows = F.when(key % 17 == 0, F.lit(-1)).otherwise(F.coalesce("n", F.lit(0)))
    size = F.when(key % 3 != 2, F.coalesce("q", F.lit(0)).cast("bigint") * 8192)
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left").select(
        key.alias("relation_id"),
        part_target().alias("target"),
        part_schema().alias("schema_name"),
        F.concat(name("t", key), ending).alias("relation_name"),
        kind.alias("relkind"),
        name("c", half("p_partkey", 4)).alias("owner"),
        rows.cast("bigint").alias("row_estimate"),
        size.cast("bigint").alias("size_bytes"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", "Failed").when(kind == "view", "running")
        .when(kind == "signup", "queued").otherwise("success")
    )
    return table(spark, sf_dir, "events").select(
        s("event_id").alias("query_id"),
        name("u", "user_id").alias("user_name"),
        name("wh", F.col("user_id") % 3).alias("target"),
        status.alias("status"),
        F.col("ts").alias("start_time"),
        F.when(~kind.isin("view", "signup"), F.floor("value").cast("bigint")).alias("duration_s"),
        F.concat(F.lit("SELECT  *\n FROM t"), s(F.col("event_id") % 50)).alias("query_text"),
    )


def role_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer belongs to c/2 and c/4, so paths differ in length and flag."""
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    near = who.where("k >= 2").select(
        name("c", "k").alias("member"), name("c", half("k", 2)).alias("role"),
        (F.col("k") % 7 != 0).alias("inherit"),
    )
    far = who.where("k >= 4").select(
        name("c", "k").alias("member"), name("c", half("k", 4)).alias("role"),
        (F.col("k") % 5 != 0).alias("inherit"),
    )
    return near.unionByName(far)


def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per grant; a NULL grantee is PUBLIC."""
    okey, cust = F.col("o_orderkey"), F.col("o_custkey")
    first = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.when(okey % 4 == 0, "schema").when(okey % 4 == 1, "sequence")
        .when(okey % 4 == 2, "function").otherwise("relation").alias("scope"),
        name("obj", half("o_orderkey", 30)).alias("object_name"),
        F.when(cust % 19 != 0, name("c", cust)).alias("grantee"),
        F.when(first == "1", "SELECT").when(first == "2", "INSERT").when(first == "3", "UPDATE")
        .when(first == "4", "DELETE").otherwise("USAGE").alias("privilege"),
        name("c", cust % 10).alias("grantor"),
        (F.col("o_orderstatus") == "P").alias("grantable"),
    )


def schema_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema grants: (schema, grantee, kind, privilege); PUBLIC has a NULL grantee."""
    cust = F.col("o_custkey")
    first = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        name("s", half("o_orderkey", 20)).alias("schema_name"),
        F.when(cust % 19 != 0, name("c", cust)).alias("grantee"),
        F.when(F.col("o_orderstatus") == "F", "group").when(F.col("o_orderstatus") == "O", "user")
        .otherwise("role").alias("grantee_kind"),
        F.when(first.isin("1", "2"), "USAGE").when(first == "3", "CREATE")
        .otherwise("TEMPORARY").alias("privilege"),
        name("c", cust % 10).alias("grantor"),
        (F.col("o_totalprice") > 200000).alias("grantable"),
    )


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model executions, one row per lineitem; invocation = order."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    schema = part_schema()
    flag = F.col("l_returnflag")
    stem = F.when(F.col("l_linestatus") == "O", "model.my_project.t").otherwise("model.my2project.t")
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        name("wh", F.col("l_partkey") % 3).alias("target"),
        schema.alias("schema_name"),
        name("t", "l_partkey").alias("name"),
        F.concat(stem, s("l_partkey")).alias("node_id"),
        F.when(flag == "A", "success").when(flag == "R", "error").otherwise("skipped").alias("status"),
        F.col("l_orderkey").alias("invocation_id"),
        F.col("l_shipdate").alias("executed_at"),
    )


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("invocation_id"),
        F.when(F.col("o_orderstatus") == "P", "run").otherwise("build").alias("command"),
        F.concat(
            F.lit('{"invocation_command": "build '), F.lower(F.substring("o_orderpriority", 3, 20)),
            F.lit('"}'),
        ).alias("invocation_args"),
        F.col("o_orderdate").alias("run_started_at"),
    )


def inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition tree: every part hangs below the part with a tenth of its key."""
    return table(spark, sf_dir, "part").where("p_partkey >= 1").select(
        F.col("p_partkey").alias("child_id"), half("p_partkey", 10).alias("parent_id")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.col("user_id").alias("connection_id"),
        F.when(kind == "error", "failed").when(kind == "view", "running")
        .when(kind == "signup", "pending").when(kind == "click", "incomplete")
        .otherwise("succeeded").alias("status"),
        F.when(F.col("event_id") % 2 == 0, "sync").otherwise("refresh").alias("job_type"),
        F.col("ts").alias("start_time"),
        F.floor("value").cast("bigint").alias("rows_synced"),
    )


def cursor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (connection, stream) with the state as a map of texts."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    form = key % 6
    value = (
        F.when(form == 0, day)
        .when(form == 1, F.replace(day, F.lit("-"), F.lit("")))
        .when(form == 2, F.concat(day, F.lit("T00:00:00.123Z")))
        .when(form == 3, F.concat(day, F.lit(" 00:00:00+02:00")))
        .otherwise(name("lsn-", key))
    )
    xid = s(key * 1000 + 5)
    plain = F.create_map(
        F.lit("cursor"), value, F.lit("cursor_record_count"), s(key % 3)
    )
    xmin = F.create_map(
        F.lit("state_type"), F.lit("xmin"),
        F.lit("xmin_xid_value"), F.when(key % 5 == 4, F.lit("n/a")).otherwise(xid),
        F.lit("xmin_raw_value"), xid,
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("connection_id"),
        name("s", key).alias("stream"),
        name("ns", F.col("o_custkey") % 4).alias("namespace"),
        F.when(form == 5, xmin).otherwise(plain).alias("state"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        name("workgroup:", F.col("user_id") % 5).alias("scope"),
        F.when(kind == "click", "CPUUtilization").when(kind == "view", "FreeableMemory")
        .when(kind == "purchase", "FreeStorageSpace").when(kind == "signup", "DatabaseConnections")
        .otherwise("EBSIOBalance%").alias("metric"),
        "ts",
        "value",
    )


def bi_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BI users with role and group ids, mixed the way the service lists them."""
    cust = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    roles = (
        F.when(key % 4 == 0, F.lit("[]"))
        .when(key % 4 == 1, F.concat(F.lit("["), s(key % 5), F.lit("]")))
        .when(key % 4 == 2, F.concat(F.lit('[{"id": '), s(key % 5), F.lit('}, 7, "x"]')))
        .otherwise(F.concat(F.lit('[{"id": '), s(key % 5), F.lit(', "name": "r"}, {"id": "9"}, 2]')))
    )
    groups = F.concat(F.lit("["), s(key % 3), F.lit(", "), s(key % 3 + key % 2), F.lit("]"))
    return cust.select(
        key.alias("user_id"),
        F.lower("c_name").alias("username"),
        F.concat(F.lit("User"), s(key), F.lit("@Example.org")).alias("email"),
        (F.col("c_acctbal") > 0).alias("active"),
        F.when(key % 6 != 0, F.initcap("c_mktsegment")).alias("first_name"),
        F.when(key % 9 != 0, name("Nation", "c_nationkey")).alias("last_name"),
        roles.alias("roles"),
        groups.alias("groups"),
    )


def rename_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied and dry renames, several per object; odd parts log for another target."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    key = F.col("l_partkey")
    schema = part_schema()
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        F.when(key % 2 == 0, name("wh", key % 3)).otherwise("old").alias("target"),
        schema.alias("schema_name"),
        name("t", key).alias("old_name"),
        F.concat(name("t", key), F.lit("_deprecated")).alias("new_name"),
        F.col("l_shipdate").alias("generated_at"),
        (F.col("l_linestatus") == "F").alias("dry_run"),
    )


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas: those that hold relations and one empty one per nation."""
    used = table(spark, sf_dir, "part").select(
        part_target().alias("target"), part_schema().alias("schema_name")
    ).distinct()
    length = F.length("schema_name")
    used = used.withColumn("owner", F.when(length % 2 == 0, name("c", length)))
    empty = table(spark, sf_dir, "nation").select(
        name("wh", F.col("n_nationkey") % 3).alias("target"),
        F.lower("n_name").alias("schema_name"),
        name("c", "n_nationkey").alias("owner"),
    )
    return used.unionByName(empty)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage: view reads table, by relation id."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("view_id"), F.col("l_partkey").alias("source_id")
    )


FX = {
    "fx_relations": """
SELECT p.p_partkey AS relation_id, concat('wh', CAST(p.p_partkey % 3 AS VARCHAR)) AS target,
       concat(CASE WHEN p.p_size <= 20 THEN 'dev_' WHEN p.p_size <= 30 THEN 'devx'
                   WHEN p.p_size <= 40 THEN 'pg_' ELSE 'prod_' END, lower(p.p_type)) AS schema_name,
       concat('t', CAST(p.p_partkey AS VARCHAR),
              CASE WHEN p.p_partkey % 11 = 0 THEN '_deprecated'
                   WHEN p.p_partkey % 13 = 0 THEN 'xdeprecated' ELSE '' END) AS relation_name,
       CASE WHEN p.p_partkey % 10 = 0 THEN 'v' WHEN p.p_partkey % 10 = 1 THEN 'm'
            WHEN p.p_partkey % 10 = 2 THEN 'p' WHEN p.p_partkey % 10 = 3 THEN 'S' ELSE 'r' END AS relkind,
       concat('c', CAST(CAST(floor(p.p_partkey / 4) AS BIGINT) AS VARCHAR)) AS owner,
       CASE WHEN p.p_partkey % 17 = 0 THEN CAST(-1 AS BIGINT) ELSE COALESCE(l.n, 0) END AS row_estimate,
       CASE WHEN p.p_partkey % 3 = 2 THEN CAST(NULL AS BIGINT)
            ELSE CAST(COALESCE(l.q, 0) AS BIGINT) * 8192 END AS size_bytes
FROM part p LEFT JOIN (SELECT l_partkey, COUNT(*) AS n, SUM(l_quantity) AS q
                       FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey""",
    "fx_query_log": """
SELECT CAST(event_id AS VARCHAR) AS query_id, concat('u', CAST(user_id AS VARCHAR)) AS user_name,
       concat('wh', CAST(user_id % 3 AS VARCHAR)) AS target,
       CASE event_type WHEN 'error' THEN 'Failed' WHEN 'view' THEN 'running'
                       WHEN 'signup' THEN 'queued' ELSE 'success' END AS status,
       ts AS start_time,
       CASE WHEN event_type IN ('view', 'signup') THEN CAST(NULL AS BIGINT)
            ELSE CAST(floor(value) AS BIGINT) END AS duration_s,
       concat('SELECT  *', chr(10), ' FROM t', CAST(event_id % 50 AS VARCHAR)) AS query_text
FROM events""",
    "fx_role_members": """
SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS member,
       concat('c', CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS VARCHAR)) AS role,
       c_custkey % 7 <> 0 AS inherit FROM customer WHERE c_custkey >= 2
UNION ALL
SELECT concat('c', CAST(c_custkey AS VARCHAR)),
       concat('c', CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS VARCHAR)),
       c_custkey % 5 <> 0 FROM customer WHERE c_custkey >= 4""",
    "fx_acl": """
SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'schema' WHEN o_orderkey % 4 = 1 THEN 'sequence'
            WHEN o_orderkey % 4 = 2 THEN 'function' ELSE 'relation' END AS scope,
       concat('obj', CAST(CAST(floor(o_orderkey / 30) AS BIGINT) AS VARCHAR)) AS object_name,
       CASE WHEN o_custkey % 19 = 0 THEN CAST(NULL AS VARCHAR)
            ELSE concat('c', CAST(o_custkey AS VARCHAR)) END AS grantee,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'SELECT' WHEN '2' THEN 'INSERT'
            WHEN '3' THEN 'UPDATE' WHEN '4' THEN 'DELETE' ELSE 'USAGE' END AS privilege,
       concat('c', CAST(o_custkey % 10 AS VARCHAR)) AS grantor,
       o_orderstatus = 'P' AS grantable
FROM orders""",
    "fx_schema_acl": """
SELECT concat('s', CAST(CAST(floor(o_orderkey / 20) AS BIGINT) AS VARCHAR)) AS schema_name,
       CASE WHEN o_custkey % 19 = 0 THEN CAST(NULL AS VARCHAR)
            ELSE concat('c', CAST(o_custkey AS VARCHAR)) END AS grantee,
       CASE o_orderstatus WHEN 'F' THEN 'group' WHEN 'O' THEN 'user' ELSE 'role' END AS grantee_kind,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'USAGE' WHEN '2' THEN 'USAGE'
            WHEN '3' THEN 'CREATE' ELSE 'TEMPORARY' END AS privilege,
       concat('c', CAST(o_custkey % 10 AS VARCHAR)) AS grantor,
       o_totalprice > 200000 AS grantable
FROM orders""",
    "fx_model_runs": """
SELECT concat('wh', CAST(p.p_partkey % 3 AS VARCHAR)) AS target,
       concat(CASE WHEN p.p_size <= 20 THEN 'dev_' WHEN p.p_size <= 30 THEN 'devx'
                   WHEN p.p_size <= 40 THEN 'pg_' ELSE 'prod_' END, lower(p.p_type)) AS schema_name,
       concat('t', CAST(p.p_partkey AS VARCHAR)) AS name,
       concat(CASE WHEN l.l_linestatus = 'O' THEN 'model.my_project.t'
                   ELSE 'model.my2project.t' END, CAST(p.p_partkey AS VARCHAR)) AS node_id,
       CASE l.l_returnflag WHEN 'A' THEN 'success' WHEN 'R' THEN 'error' ELSE 'skipped' END AS status,
       l.l_orderkey AS invocation_id
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "fx_invocations": """
SELECT o_orderkey AS invocation_id,
       CASE WHEN o_orderstatus = 'P' THEN 'run' ELSE 'build' END AS command,
       concat('{"invocation_command": "build ', lower(substr(o_orderpriority, 3, 20)), '"}') AS invocation_args,
       o_orderdate AS run_started_at
FROM orders""",
    "fx_inherits": """
SELECT p_partkey AS child_id, CAST(floor(p_partkey / 10) AS BIGINT) AS parent_id
FROM part WHERE p_partkey >= 1""",
    "fx_jobs": """
SELECT event_id AS job_id, user_id AS connection_id,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running'
            WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'incomplete' ELSE 'succeeded' END AS status,
       CASE WHEN event_id % 2 = 0 THEN 'sync' ELSE 'refresh' END AS job_type,
       ts AS start_time, CAST(floor(value) AS BIGINT) AS rows_synced
FROM events""",
    "fx_cursor": """
SELECT o_custkey AS connection_id, concat('s', CAST(o_orderkey AS VARCHAR)) AS stream,
       concat('ns', CAST(o_custkey % 4 AS VARCHAR)) AS namespace,
       o_orderkey % 6 AS form, CAST(o_orderdate AS DATE) AS day,
       CASE o_orderkey % 6
            WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR)
            WHEN 1 THEN replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-', '')
            WHEN 2 THEN concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'T00:00:00.123Z')
            WHEN 3 THEN concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), ' 00:00:00+02:00')
            WHEN 4 THEN concat('lsn-', CAST(o_orderkey AS VARCHAR))
            ELSE CASE WHEN o_orderkey % 5 = 4 THEN 'n/a'
                      ELSE CAST(o_orderkey * 1000 + 5 AS VARCHAR) END END AS value,
       CAST(o_orderkey % 3 AS BIGINT) AS record_count
FROM orders""",
    "fx_metric_points": """
SELECT concat('workgroup:', CAST(user_id % 5 AS VARCHAR)) AS scope,
       CASE event_type WHEN 'click' THEN 'CPUUtilization' WHEN 'view' THEN 'FreeableMemory'
            WHEN 'purchase' THEN 'FreeStorageSpace' WHEN 'signup' THEN 'DatabaseConnections'
            ELSE 'EBSIOBalance%' END AS metric, ts, value
FROM events""",
    "fx_bi_users": """
SELECT c_custkey AS user_id, lower(c_name) AS username,
       concat('User', CAST(c_custkey AS VARCHAR), '@Example.org') AS email, c_acctbal > 0 AS active,
       CASE WHEN c_custkey % 6 <> 0
            THEN concat(substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2))) END AS first_name,
       CASE WHEN c_custkey % 9 <> 0 THEN concat('Nation', CAST(c_nationkey AS VARCHAR)) END AS last_name,
       CASE c_custkey % 4 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN [c_custkey % 5]
            WHEN 2 THEN [c_custkey % 5, 7] ELSE [c_custkey % 5, 2] END AS role_ids,
       [c_custkey % 3, c_custkey % 3 + c_custkey % 2] AS group_ids
FROM customer""",
    "fx_rename_log": """
SELECT CASE WHEN p.p_partkey % 2 = 0 THEN concat('wh', CAST(p.p_partkey % 3 AS VARCHAR))
            ELSE 'old' END AS target,
       concat(CASE WHEN p.p_size <= 20 THEN 'dev_' WHEN p.p_size <= 30 THEN 'devx'
                   WHEN p.p_size <= 40 THEN 'pg_' ELSE 'prod_' END, lower(p.p_type)) AS schema_name,
       concat('t', CAST(p.p_partkey AS VARCHAR)) AS old_name,
       concat('t', CAST(p.p_partkey AS VARCHAR), '_deprecated') AS new_name,
       l.l_shipdate AS generated_at, l.l_linestatus = 'F' AS dry_run
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "fx_namespaces": """
SELECT target, schema_name, CASE WHEN length(schema_name) % 2 = 0
            THEN concat('c', CAST(length(schema_name) AS VARCHAR)) END AS owner
FROM (SELECT DISTINCT target, schema_name FROM fx_relations) d
UNION ALL
SELECT concat('wh', CAST(n_nationkey % 3 AS VARCHAR)), lower(n_name),
       concat('c', CAST(n_nationkey AS VARCHAR)) FROM nation""",
    "fx_walk": """
SELECT member, role, 1 AS depth, member AS via, inherit FROM fx_role_members
UNION
SELECT w.member, e.role, w.depth + 1, w.role, w.inherit AND e.inherit
FROM fx_walk w JOIN fx_role_members e ON e.member = w.role WHERE w.depth < 60""",
    "fx_ancestors": """
SELECT member, role, CAST(min(depth) AS INTEGER) AS depth, bool_or(inherit) AS inherit,
       min(via) FILTER (WHERE depth = first_depth) AS via
FROM (SELECT *, min(depth) OVER (PARTITION BY member, role) AS first_depth FROM fx_walk) w
WHERE member <> role GROUP BY member, role""",
}

# What each derived input reads, in the order the WITH clause needs.
_NEEDS = {
    "fx_namespaces": ["fx_relations"],
    "fx_walk": ["fx_role_members"],
    "fx_ancestors": ["fx_walk"],
}


def with_fx(names: str, body: str) -> str:
    """Prefix ``body`` with the derived inputs it names."""
    ordered: list[str] = []

    def add(item: str) -> None:
        for needed in _NEEDS.get(item, []):
            add(needed)
        if item not in ordered:
            ordered.append(item)

    for item in names.split():
        add(item)
    ctes = ",\n".join(f"{item} AS ({FX[item].strip()})" for item in ordered)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"
