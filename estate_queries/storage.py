"""Storage ranking and shared predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate.functions import predicates as P
from estate.operators import connections as C
from estate.operators import storage as S
from estate_queries import fixtures as X
from estate_queries.fixtures import with_fx

SIZELESS = ("wh2",)


def _prefix(spark, d):
    return P.with_prefix(X.relations(spark, d), "schema_name", ["dev_", "pg_"]).select(
        "relation_id", "schema_name", "relation_name")


def _glob(spark, d):
    rel = X.relations(spark, d)
    return rel.where(P.glob("schema_name", "*_s*")).select("relation_id", "schema_name")


def _suffix(spark, d):
    return P.with_suffix(X.relations(spark, d), "relation_name", "_deprecated").select(
        "relation_id", "relation_name")


def _system(spark, d):
    return P.hide_system(X.relations(spark, d)).select("relation_id", "schema_name")


def _protected(spark, d):
    shouted = X.namespaces(spark, d).withColumn("schema_name", F.upper("schema_name"))
    return shouted.select("target", "schema_name", P.is_protected().alias("protected"))


def _exclude(spark, d):
    rel = X.relations(spark, d)
    fixed = P.exclude(rel, ["prod_economy # finance", "", "# none", "dev_small.t3"])
    tokens = X.table(spark, d, "supplier").select(
        F.concat(F.lit("devxpromo.t"), X.s("s_suppkey"), F.lit(" # "), "s_name").alias("token"))
    return P.exclude(fixed, tokens).select("relation_id", "schema_name", "relation_name")


def _connections(spark, d):
    rows = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("connectionId"),
        F.when(F.col("o_orderstatus") == "F", "active").when(
            F.col("o_orderstatus") == "O", "Active").otherwise("inactive").alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 5).alias("workspaceId"),
        F.when(F.col("o_orderkey") % 2 == 1, F.col("o_custkey") % 5).alias("workspace_id"),
        (F.col("o_custkey") % 3).alias("sourceId"))
    return C.filter_connections(rows, active_only=True, workspace=2, source=1).select(
        F.col("connectionId").alias("connection_id"))


def catalog_streams():
    """A stream list whose selection flag sits in one of three places."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    flag = F.col("o_totalprice") > 250000
    none = F.lit(None).cast("boolean")
    return F.array(
        F.struct(F.struct(F.when(key % 3 == 0, flag).alias("selected")).alias("config"),
                 F.when(key % 3 == 1, flag).alias("selected"),
                 F.struct(F.when(key % 3 == 2, flag).alias("selected")).alias("stream")),
        F.struct(F.struct(none.alias("selected")).alias("config"), none.alias("selected"),
                 F.struct(F.when(cust % 2 == 0, F.lit(False)).alias("selected")).alias("stream")))


def _idle(spark, d):
    rows = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("connection_id"),
        F.when(F.col("o_orderstatus") == "P", "inactive").otherwise("active").alias("status"),
        catalog_streams().alias("streams"))
    return C.idle_connections(rows).select("connection_id")


def _roles(spark, d):
    rows = X.table(spark, d, "customer").select(
        F.col("c_name").alias("role"), (F.col("c_acctbal") > 0).alias("can_login"))
    return C.filter_roles(rows, contains="#0000000", users_only=True)


def _owner_rows(spark, d):
    own = X.acl(spark, d).withColumn(
        "privilege", F.when(F.col("grantable"), "OWNER").otherwise(F.col("privilege")))
    return C.without_owner_rows(own).select("scope", "object_name", "grantee", "privilege")


def _search(spark, d):
    return P.search_rows(X.table(spark, d, "customer"), "BUILD").select("c_custkey", "c_name")


def _top(spark, d):
    return S.top_relations(X.relations(spark, d), "dev_", 20, SIZELESS).select(
        "target", "rank", "schema_name", "relation_name", "relkind", "row_estimate", "size_bytes")


def _ranked_by(spark, d):
    return S.top_relations(X.relations(spark, d), ["dev_", "prod_"], 30, SIZELESS).select(
        "target", "rank", "ranked_by", "schema_name", "relation_name", "row_estimate", "size_bytes")


def _summary(spark, d):
    out = S.storage_summary(X.relations(spark, d), "dev_", 20)
    return out.withColumn("pct_of_disk", F.round("pct_of_disk", 6))


def _drop(spark, d):
    rel = X.relations(spark, d)
    top = S.top_relations(rel, "dev_", 15, SIZELESS)
    out = S.drop_plan(top, S.storage_summary(rel, "dev_", 15))
    return out.withColumn("pct_of_disk", F.round("pct_of_disk", 6))


def _highlights(spark, d):
    return S.schema_highlights(X.relations(spark, d))


def _page(spark, d):
    orders = X.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return S.page(orders, ["o_custkey", "o_orderkey"], 100, 3)


def _deep_page(spark, d):
    rows = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return S.Pages(rows, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"]).page(41, 100)


def _page_after(spark, d):
    orders = X.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return S.page_after(orders, "o_orderkey", 1000, 100)


def _cap(spark, d):
    rows = X.acl(spark, d).select("grantor", "object_name", "privilege", "scope", "grantee")
    return S.cap(rows, ["grantor"], ["object_name", "privilege", "scope",
                                     F.col("grantee").asc_nulls_first()], 8)


def _report(spark, d):
    return S.top_relations_report(S.top_relations(X.relations(spark, d), "dev_", 20, SIZELESS))


QUERIES = {
    "b1_literal_prefix": _prefix,
    "b2_glob": _glob,
    "b3_literal_suffix": _suffix,
    "b4_hide_system": _system,
    "b5_protected_schemas": _protected,
    "b6_exclude_tokens": _exclude,
    "b7_filter_connections": _connections,
    "b8_idle_connections": _idle,
    "b9_busy_connections": lambda spark, d: C.busy_connections(X.jobs(spark, d)),
    "b10_filter_roles": _roles,
    "b11_search_rows": _search,
    "b12_without_owner_rows": _owner_rows,
    "c1_top_relations": _top,
    "c2_rank_by_rows": _ranked_by,
    "c3_storage_summary": _summary,
    "c4_drop_plan": _drop,
    "c5_schema_highlights": _highlights,
    "c6_page": _page,
    "c6_page_after": _page_after,
    "c6_deep_page": _deep_page,
    "c7_cap_hidden": _cap,
    "k2_readable_ranking": _report,
}

_TOP = """
, ranked AS (
  SELECT target, schema_name, relation_name, relkind,
         CASE WHEN row_estimate >= 0 THEN row_estimate END AS row_estimate, size_bytes,
         CASE WHEN target = 'wh2' THEN 'rows' ELSE 'size' END AS ranked_by
  FROM fx_relations WHERE relkind IN ('r', 'p', 'm') AND ({match})),
top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY
         CASE WHEN target = 'wh2' THEN row_estimate ELSE size_bytes END DESC NULLS LAST,
         schema_name, relation_name) AS INTEGER) AS rank FROM ranked)
"""


def _top_sql(match: str, body: str) -> str:
    head = with_fx("fx_relations", "")
    return head + _TOP.format(match=match) + body


_DEV = "starts_with(schema_name, 'dev_')"
_SUMMARY = """
SELECT target,
       CAST(CASE WHEN count(*) FILTER (WHERE hit) = 0 THEN 0 ELSE sum(size_bytes) FILTER (WHERE hit) END AS BIGINT) AS matched_bytes,
       count(*) FILTER (WHERE hit) AS matched_count,
       CAST(sum(size_bytes) FILTER (WHERE stored) AS BIGINT) AS disk_bytes
FROM (SELECT *, relkind IN ('r', 'p', 'm') AS stored,
             relkind IN ('r', 'p', 'm') AND starts_with(schema_name, 'dev_') AS hit
      FROM fx_relations) m GROUP BY target"""

ORACLE = {
    "b1_literal_prefix": with_fx("fx_relations", """
SELECT relation_id, schema_name, relation_name FROM fx_relations
WHERE starts_with(schema_name, 'dev_') OR starts_with(schema_name, 'pg_')"""),
    "b2_glob": with_fx("fx_relations", """
SELECT relation_id, schema_name FROM fx_relations WHERE contains(schema_name, '_s')"""),
    "b3_literal_suffix": with_fx("fx_relations", """
SELECT relation_id, relation_name FROM fx_relations WHERE right(relation_name, 11) = '_deprecated'"""),
    "b4_hide_system": with_fx("fx_relations", """
SELECT relation_id, schema_name FROM fx_relations
WHERE left(schema_name, 3) <> 'pg_' AND schema_name <> 'information_schema'"""),
    "b5_protected_schemas": with_fx("fx_namespaces", """
SELECT target, upper(schema_name) AS schema_name, left(schema_name, 3) = 'pg_' AS protected
FROM fx_namespaces"""),
    "b6_exclude_tokens": with_fx("fx_relations", """
SELECT relation_id, schema_name, relation_name FROM fx_relations r
WHERE schema_name <> 'prod_economy' AND NOT (schema_name = 'dev_small' AND relation_name = 't3')
  AND NOT EXISTS (SELECT 1 FROM supplier WHERE r.schema_name = 'devxpromo'
                  AND r.relation_name = concat('t', CAST(s_suppkey AS VARCHAR)))"""),
    "b7_filter_connections": """
SELECT o_orderkey AS connection_id FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_custkey % 5 = 2 AND o_custkey % 3 = 1""",
    "b8_idle_connections": """
SELECT o_orderkey AS connection_id FROM orders
WHERE o_orderstatus <> 'P' AND NOT (o_totalprice > 250000)""",
    "b9_busy_connections": with_fx("fx_jobs", """
SELECT connection_id, count(*) AS busy_jobs FROM (
  SELECT *, row_number() OVER (PARTITION BY connection_id ORDER BY start_time DESC NULLS LAST, job_id DESC) AS rn
  FROM fx_jobs) j
WHERE rn <= 5 AND status IN ('running', 'pending', 'incomplete') GROUP BY connection_id"""),
    "b10_filter_roles": """
SELECT c_name AS role, TRUE AS can_login FROM customer
WHERE contains(lower(c_name), '#0000000') AND c_acctbal > 0""",
    "b11_search_rows": """
SELECT c_custkey, c_name FROM customer
WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')""",
    "b12_without_owner_rows": with_fx("fx_acl", """
SELECT scope, object_name, grantee, privilege FROM fx_acl WHERE NOT grantable"""),
    "c1_top_relations": _top_sql(_DEV, """
SELECT target, rank, schema_name, relation_name, relkind, row_estimate, size_bytes FROM top WHERE rank <= 20"""),
    "c2_rank_by_rows": _top_sql(_DEV + " OR starts_with(schema_name, 'prod_')", """
SELECT target, rank, ranked_by, schema_name, relation_name, row_estimate, size_bytes FROM top WHERE rank <= 30"""),
    "c3_storage_summary": with_fx("fx_relations", f"""
SELECT target, matched_bytes, matched_count, disk_bytes,
       CASE WHEN disk_bytes > 0 THEN round(matched_bytes * 100.0::DOUBLE / disk_bytes, 6) END AS pct_of_disk,
       least(matched_count, 20) AS shown, matched_count - least(matched_count, 20) AS remaining
FROM ({_SUMMARY}) t"""),
    "c4_drop_plan": _top_sql(_DEV, f"""
SELECT t.target, rank, schema_name, relation_name, size_bytes,
       CASE WHEN disk_bytes > 0 THEN round(size_bytes * 100.0::DOUBLE / disk_bytes, 6) END AS pct_of_disk,
       CASE WHEN relkind = 'm' THEN 'DROP MATERIALIZED VIEW ' ELSE 'DROP TABLE ' END
       || '"' || schema_name || '"."' || relation_name || '";' AS statement
FROM top t LEFT JOIN ({_SUMMARY}) z ON z.target = t.target WHERE rank <= 15"""),
    "c5_schema_highlights": with_fx("fx_relations", """
SELECT target, schema_name, CAST(rn AS INTEGER) AS rank, relation_name,
       CASE relkind WHEN 'r' THEN 'table' WHEN 'v' THEN 'view' WHEN 'm' THEN 'matview'
                    WHEN 'p' THEN 'partitioned table' WHEN 'S' THEN 'sequence' END AS kind, size_bytes
FROM (SELECT *, row_number() OVER (PARTITION BY target, schema_name ORDER BY size_bytes DESC, relation_name) AS rn
      FROM fx_relations WHERE size_bytes > 0) r WHERE rn <= 5"""),
    "c6_page": """
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) > 300 AS has_more
FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100 OFFSET 200""",
    "c6_page_after": """
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders WHERE o_orderkey > 1000) > 100 AS has_more
FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100""",
    "c6_deep_page": """
SELECT l_orderkey, l_linenumber, l_extendedprice, (SELECT count(*) FROM lineitem) > 4100 AS has_more
FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100 OFFSET 4000""",
    "c7_cap_hidden": with_fx("fx_acl", """
SELECT grantor, object_name, privilege, scope, grantee, CAST(rn AS INTEGER) AS rank,
       greatest(n - 8, 0) AS hidden
FROM (SELECT *, row_number() OVER (PARTITION BY grantor ORDER BY object_name, privilege, scope, grantee NULLS FIRST) AS rn,
             count(*) OVER (PARTITION BY grantor) AS n FROM fx_acl) g WHERE rn <= 8"""),
    "k2_readable_ranking": _top_sql(_DEV, """
SELECT target, rank, schema_name, relation_name,
       CASE relkind WHEN 'r' THEN 'table' WHEN 'm' THEN 'matview' ELSE 'partitioned table' END AS kind,
       CASE WHEN target = 'wh2' OR size_bytes IS NULL THEN '—'
            WHEN size_bytes < 1024 THEN concat(CAST(size_bytes AS VARCHAR), ' B')
            WHEN size_bytes < 1048576 THEN printf('%.1f KiB', size_bytes / 1024.0::DOUBLE)
            WHEN size_bytes < 1073741824 THEN printf('%.1f MiB', size_bytes / 1048576.0::DOUBLE)
            ELSE printf('%.1f GiB', size_bytes / 1073741824.0::DOUBLE) END AS size,
       CASE WHEN row_estimate IS NULL THEN '—' ELSE format('{:,}', row_estimate) END AS rows,
       ranked_by
FROM top WHERE rank <= 20"""),
}
