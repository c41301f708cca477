"""Schema roster, quotas and privilege plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate.operators import grants as G
from estate_queries import fixtures as X
from estate_queries.fixtures import with_fx


def _roster(spark, d, **kw):
    return G.schema_roster(X.namespaces(spark, d), X.relations(spark, d), **kw)


def _quota(spark, d):
    length = F.length("schema_name")
    rel = X.relations(spark, d).groupBy("target", "schema_name").agg(
        F.sum(F.col("size_bytes")).alias("b"))
    text = (
        F.when(length % 6 == 0, F.concat(F.lit(" "), X.s(length), F.lit(" gb")))
        .when(length % 6 == 1, F.lit("unlimited")).when(length % 6 == 2, F.lit("0 MB"))
        .when(length % 6 == 3, F.concat(X.s(length * 100), F.lit("MB"))).when(length % 6 == 4, F.lit("12 KB"))
        .otherwise(F.lit("001 TB")))
    quotas = rel.select("target", "schema_name", text.alias("quota"),
                        (F.col("b") / 1048576).cast("bigint").alias("used_mb"))
    return G.schema_quota(_roster(spark, d, include_system=True), quotas).withColumn(
        "used_share", F.round("used_share", 6)).drop("tables", "views", "other")


def _requests(spark, d):
    o = X.table(spark, d, "orders")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    tokens = (
        F.when(key % 7 == 0, "read").when(key % 7 == 1, "ReadWrite, select").when(key % 7 == 2, "insert,,delete")
        .when(key % 7 == 3, "all, usage,all").when(key % 7 == 4, "sequence-usage,function-execute")
        .when(key % 7 == 5, "drop,select").otherwise(" , "))
    home = X.half("o_orderkey", 20)
    return o.select(
        key.alias("request_id"), F.when(key % 2 == 0, "redshift").otherwise("postgresql").alias("engine"),
        F.array(X.name("s", home), X.name("s", home + 1), X.name("s", home)).alias("schemas"),
        F.when(cust % 19 == 0, F.lit("public")).otherwise(X.name("c", cust)).alias("grantee"),
        F.when(cust % 11 != 0, F.when(F.col("o_orderstatus") == "F", "group")
               .when(F.col("o_orderstatus") == "O", "user").otherwise("role")).alias("kind"),
        tokens.alias("tokens"))


def _expand(spark, d):
    out = G.expand_privileges(_requests(spark, d))
    return out.select("request_id", F.array_join("privileges", ",").alias("privileges"),
                      F.array_join("unknown", ",").alias("unknown"), "status")


def _merge(spark, d):
    return G.merge_requests(_requests(spark, d)).withColumn("privileges", F.array_join("privileges", ","))


def _held(spark, d):
    return G.held_schema_privileges(X.schema_acl(spark, d), G.grantees_of(_requests(spark, d)))


def _plan(spark, d, revoke=False):
    requests = G.expand_privileges(_requests(spark, d))
    owners = X.table(spark, d, "customer").where("c_acctbal > 0").select(
        X.name("s", "c_custkey").alias("schema_name"), X.name("c", "c_custkey").alias("owner"))
    held = _held(spark, d).withColumn(
        "grantee", F.when(F.col("grantee") == "PUBLIC", F.lit("public")).otherwise(F.col("grantee")))
    return G.schema_grant_plan(requests, held, owners, revoke=revoke, cascade=revoke)


def _names(spark, d):
    part = X.table(spark, d, "part")
    key = F.col("p_partkey")
    return part.select(
        X.part_target().alias("target"),
        F.when(key % 4 == 0, X.part_schema()).when(key % 4 == 1, X.name("nation_", key % 40))
        .when(key % 4 == 2, F.lit("Public")).otherwise(F.concat(F.lit("pg_"), X.s(key % 9))).alias("schema_name"))


def _drop(spark, d):
    named = G.schema_drop_impact(_roster(spark, d, include_system=True), _names(spark, d))
    globbed = G.schema_drop_impact(_roster(spark, d, include_system=True), like="*_s*", cascade=True)
    return named.withColumn("mode", F.lit("names")).unionByName(globbed.withColumn("mode", F.lit("glob")))


QUERIES = {
    "g1_schema_roster": _roster,
    "g1_schema_roster_glob": lambda s, d: _roster(s, d, like="*o*o*", include_system=True),
    "g2_schema_quota": _quota,
    "g4_expand_privileges": _expand,
    "g5_merge_requests": _merge,
    "g6_held_schema_privileges": _held,
    "g7_schema_grant_plan": _plan,
    "g7_schema_revoke_plan": lambda s, d: _plan(s, d, True),
    "g8_schema_drop_impact": _drop,
}

_ROSTER = """
roster AS (
  SELECT n.target, n.schema_name, coalesce(n.owner, '?') AS owner, count(r.relation_id) FILTER (WHERE relkind IN ('r', 'p', 'f')) AS tables,
         count(r.relation_id) FILTER (WHERE relkind IN ('v', 'm')) AS views, count(r.relation_id) FILTER (WHERE relkind = 'S') AS other
  FROM fx_namespaces n LEFT JOIN fx_relations r ON r.target = n.target AND r.schema_name = n.schema_name GROUP BY 1, 2, 3)"""
_REQ = """
req AS (
  SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'redshift' ELSE 'postgresql' END AS engine,
         CAST(floor(o_orderkey / 20) AS BIGINT) AS home, CASE WHEN o_custkey % 19 = 0 THEN 'public' ELSE concat('c', CAST(o_custkey AS VARCHAR)) END AS grantee,
         CASE WHEN o_custkey % 11 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'group' WHEN 'O' THEN 'user' ELSE 'role' END END AS kind,
         ['usage,select,default-select', 'usage,create,select,table-all,default-all', 'usage,insert,delete', 'usage,all',
          'usage,sequence-usage,function-execute', 'usage,select', ''][o_orderkey % 7 + 1] AS privileges,
         CASE WHEN o_orderkey % 7 = 5 THEN 'drop' ELSE '' END AS unknown,
         CASE o_orderkey % 7 WHEN 5 THEN 'unknown_privilege' WHEN 6 THEN 'no_privilege' ELSE 'ok' END AS status FROM orders),
ord AS (SELECT unnest(['usage', 'create', 'all', 'select', 'insert', 'update', 'delete', 'table-all', 'sequence-usage',
         'function-execute', 'default-select', 'default-all']) AS privilege, unnest(range(1, 13)) AS position)"""
_HELD = """
held AS (
  SELECT DISTINCT a.schema_name, coalesce(a.grantee, 'PUBLIC') AS grantee, lower(a.privilege) AS privilege FROM fx_schema_acl a
  WHERE privilege IN ('USAGE', 'CREATE') AND (
    (a.grantee IS NULL AND EXISTS (SELECT 1 FROM req WHERE grantee = 'public'))
    OR (a.grantee, a.grantee_kind) IN (SELECT (grantee, kind) FROM req WHERE kind IS NOT NULL)))"""


def _plan_sql(revoke: bool) -> str:
    verb, to, tail = ("REVOKE", "FROM", " CASCADE;") if revoke else ("GRANT", "TO", ";")
    held = "" if revoke else "WHEN h.privilege IS NOT NULL AND o.position <= 3 THEN 'already_held'"
    join = "" if revoke else (
        "LEFT JOIN held h ON h.schema_name = a.schema_name AND h.privilege = a.privilege "
        "AND (h.grantee = a.grantee OR (h.grantee = 'PUBLIC' AND a.grantee = 'public'))")
    return with_fx("fx_schema_acl", "").rstrip() + "," + _REQ + "," + _HELD + f"""
, asked AS (
  SELECT request_id, engine, grantee, kind, concat('s', CAST(home + z.i AS VARCHAR)) AS schema_name, home + z.i AS num, p.privilege
  FROM req, (SELECT 0 AS i UNION ALL SELECT 1) z, LATERAL (SELECT unnest(string_split(privileges, ',')) AS privilege) p WHERE privileges <> ''),
d AS (
  SELECT a.*, o.position, c.c_custkey IS NOT NULL AS owned,
    CASE WHEN a.grantee = 'public' THEN 'PUBLIC' WHEN engine = 'redshift' AND kind = 'group' THEN concat('GROUP "', a.grantee, '"')
         WHEN engine = 'redshift' AND kind = 'role' THEN concat('ROLE "', a.grantee, '"') ELSE concat('"', a.grantee, '"') END AS who,
    CASE WHEN kind IS NULL AND a.grantee <> 'public' THEN 'error:grantee_not_found' {held}
      WHEN engine = 'redshift' AND (a.privilege = 'sequence-usage' OR (o.position >= 11 AND kind = 'role' AND a.grantee <> 'public')) THEN 'skip:unsupported'
      WHEN o.position >= 11 AND c.c_custkey IS NULL THEN 'error:no_grantor' ELSE '{verb.lower()}' END AS action
  FROM asked a JOIN ord o ON o.privilege = a.privilege
  LEFT JOIN customer c ON c.c_custkey = a.num AND c.c_acctbal > 0 {join})
SELECT request_id, schema_name, grantee, kind, privilege, CAST(position AS INTEGER) AS position, action,
  CASE WHEN action = '{verb.lower()}' THEN concat(CASE
    WHEN position <= 3 THEN concat('{verb} ', upper(privilege), ' ON SCHEMA "', schema_name, '"')
    WHEN position <= 8 THEN concat('{verb} ', CASE WHEN privilege = 'table-all' THEN 'ALL' ELSE upper(privilege) END, ' ON ALL TABLES IN SCHEMA "', schema_name, '"')
    WHEN position = 9 THEN concat('{verb} USAGE ON ALL SEQUENCES IN SCHEMA "', schema_name, '"')
    WHEN position = 10 THEN concat('{verb} EXECUTE ON ALL FUNCTIONS IN SCHEMA "', schema_name, '"')
    ELSE concat('ALTER DEFAULT PRIVILEGES FOR ', CASE WHEN engine = 'redshift' THEN 'USER' ELSE 'ROLE' END, ' "c', CAST(num AS VARCHAR),
      '" IN SCHEMA "', schema_name, '" {verb} ', CASE WHEN position = 12 THEN 'ALL' ELSE 'SELECT' END, ' ON TABLES') END,
    ' {to} ', who, '{tail}') END AS statement
FROM d"""


ORACLE = {
    "g1_schema_roster": with_fx("fx_relations fx_namespaces", "").rstrip() + "," + _ROSTER + """
SELECT * FROM roster WHERE left(schema_name, 3) <> 'pg_' AND schema_name <> 'information_schema'""",
    "g1_schema_roster_glob": with_fx("fx_relations fx_namespaces", "").rstrip() + "," + _ROSTER + """
SELECT * FROM roster WHERE length(schema_name) - length(replace(schema_name, 'o', '')) >= 2""",
    "g2_schema_quota": with_fx("fx_relations fx_namespaces", "").rstrip() + "," + _ROSTER + """
, q AS (SELECT target, schema_name, length(schema_name) AS n, CAST(floor(sum(size_bytes) / 1048576) AS BIGINT) AS used_mb FROM fx_relations GROUP BY 1, 2)
SELECT target, schema_name, owner, CASE n % 6 WHEN 0 THEN concat(CAST(n AS VARCHAR), ' GB') WHEN 1 THEN 'UNLIMITED'
         WHEN 3 THEN concat(CAST(n * 100 AS VARCHAR), ' MB') WHEN 5 THEN '1 TB' END AS quota,
       CASE n % 6 WHEN 0 THEN n * 1024 WHEN 3 THEN n * 100 WHEN 5 THEN 1048576 END AS quota_mb,
       CASE WHEN n IS NOT NULL THEN n % 6 NOT IN (2, 4) END AS quota_valid, used_mb,
       round(used_mb / (CASE n % 6 WHEN 0 THEN n * 1024 WHEN 3 THEN n * 100 WHEN 5 THEN 1048576 END), 6) AS used_share
FROM roster LEFT JOIN q USING (target, schema_name)""",
    "g4_expand_privileges": "WITH" + _REQ + " SELECT request_id, privileges, unknown, status FROM req",
    "g5_merge_requests": "WITH" + _REQ + """
, x AS (SELECT DISTINCT r.grantee, o.privilege, o.position FROM req r, LATERAL (SELECT unnest(string_split(r.privileges, ',')) AS privilege) p
        JOIN ord o ON o.privilege = p.privilege)
SELECT g.grantee, requests, bad_requests, coalesce(privileges, '') AS privileges
FROM (SELECT grantee, count(*) AS requests, count(*) FILTER (WHERE unknown <> '') AS bad_requests FROM req GROUP BY 1) g
LEFT JOIN (SELECT grantee, string_agg(privilege, ',' ORDER BY position) AS privileges FROM x GROUP BY 1) m ON m.grantee = g.grantee""",
    "g6_held_schema_privileges": with_fx("fx_schema_acl", "").rstrip() + "," + _REQ + "," + _HELD + " SELECT * FROM held",
    "g7_schema_grant_plan": _plan_sql(False),
    "g7_schema_revoke_plan": _plan_sql(True),
    "g8_schema_drop_impact": with_fx("fx_relations fx_namespaces", "").rstrip() + "," + _ROSTER + """
, n AS (
  SELECT DISTINCT concat('wh', CAST(p_partkey % 3 AS VARCHAR)) AS target, CASE p_partkey % 4 WHEN 0 THEN r.schema_name
    WHEN 1 THEN concat('nation_', CAST(p_partkey % 40 AS VARCHAR)) WHEN 2 THEN 'Public' ELSE concat('pg_', CAST(p_partkey % 9 AS VARCHAR)) END AS schema_name
  FROM part JOIN fx_relations r ON r.relation_id = p_partkey),
i AS (
  SELECT n.*, tables + views + other AS objects, CASE WHEN left(schema_name, 3) = 'pg_' OR schema_name = 'Public' THEN 'protected'
    WHEN tables IS NULL THEN 'missing' WHEN tables + views + other > 0 THEN 'blocked' ELSE 'ok' END AS status
  FROM n LEFT JOIN roster USING (target, schema_name))
SELECT target, schema_name, status, objects, CASE WHEN status = 'ok' THEN concat('DROP SCHEMA "', schema_name, '" RESTRICT;') END AS statement, 'names' AS mode FROM i
UNION ALL SELECT target, schema_name, 'ok', tables + views + other, concat('DROP SCHEMA "', schema_name, '" CASCADE;'), 'glob'
FROM roster WHERE contains(schema_name, '_s') AND left(schema_name, 3) <> 'pg_'""",
}
