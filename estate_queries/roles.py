"""Role graph, effective privileges, membership and ownership plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from estate.operators import principals as N
from estate.operators import roles as R
from estate_queries import fixtures as X
from estate_queries.fixtures import with_fx


def _roles(spark, d):
    cust = X.table(spark, d, "customer")
    bal = F.col("c_acctbal")
    return cust.select(
        X.name("c", "c_custkey").alias("role"), (bal > 0).alias("can_login"),
        (bal > 9000).alias("superuser"), (F.col("c_nationkey") % 2 == 0).alias("create_db"),
        (F.col("c_nationkey") % 3 == 0).alias("create_role"))


def _holders(spark, d, direct=False):
    up = None if direct else R.ancestors(X.role_members(spark, d))
    return R.privilege_closure(_roles(spark, d), up, public=False)


def _closure_set(spark, d):
    up = R.ancestors(X.role_members(spark, d))
    return R.privilege_closure(_roles(spark, d), up)


def _groups(spark, d):
    """Groups with member ids, from orders: one small array per order."""
    o = X.table(spark, d, "orders")
    return o.select(X.name("g", "o_orderkey").alias("group_name"),
                    F.array("o_custkey", X.half("o_custkey", 2)).alias("member_ids"))


def _group_members(spark, d):
    users = X.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return R.group_members(_groups(spark, d), users)


def _default_acl(spark, d):
    o = X.table(spark, d, "orders")
    code = F.col("o_orderkey") % 5
    return o.select(
        X.name("c", F.col("o_custkey") % 10).alias("owner"),
        F.when(F.col("o_orderkey") % 3 != 0, X.name("s", X.half("o_orderkey", 20))).alias("schema_name"),
        F.when(code == 0, "r").when(code == 1, "S").when(code == 2, "f").when(code == 3, "T")
        .otherwise("n").alias("object_code"),
        F.when(F.col("o_custkey") % 19 != 0, X.name("c", "o_custkey")).alias("grantee"),
        F.col("o_orderstatus").alias("privilege"), (F.col("o_totalprice") > 300000).alias("grantable"))


def _attributes(spark, d):
    cust = X.table(spark, d, "customer")
    key, grp = F.col("c_custkey"), F.col("c_mktsegment") == "MACHINERY"
    flag = lambda c: F.when(~grp, c)
    rows = cust.select(
        X.name("c", key).alias("role"), grp.alias("is_group"),
        flag(F.col("c_acctbal") > 0).alias("can_login"), flag(F.col("c_acctbal") > 9000).alias("superuser"),
        flag(key % 2 == 0).alias("create_db"), flag(key % 3 == 0).alias("create_role"),
        flag(key % 4 != 0).alias("inherit"), flag(key % 5 == 0).alias("replication"),
        flag(key % 7 == 0).alias("bypass_rls"), flag(F.lit(10)).alias("connection_limit"))
    secrets = X.table(spark, d, "customer").where("c_acctbal > 1000").select(
        X.name("c", "c_custkey").alias("role"),
        F.when(F.col("c_nationkey") > 5, F.lit("md5x")).alias("verifier"))
    with_store = R.role_attributes(rows, secrets).withColumn("store", F.lit("readable"))
    without = R.role_attributes(rows).withColumn("store", F.lit("unreadable"))
    return with_store.unionByName(without).select(
        "store", "role", "can_login", "connection_limit", "password_set", "flags")


def _principals(spark, d):
    cust = X.table(spark, d, "customer")
    supp = X.table(spark, d, "supplier")
    nat = X.table(spark, d, "nation")
    return (
        cust.select(X.name("n", "c_custkey").alias("name"), F.lit("user").alias("kind"))
        .unionByName(supp.select(X.name("n", F.col("s_suppkey") * 3).alias("name"), F.lit("role").alias("kind")))
        .unionByName(nat.select(X.name("n", F.col("n_nationkey") * 9).alias("name"), F.lit("group").alias("kind"))))


def _kinds(spark, d):
    names = X.table(spark, d, "orders").select(
        F.when(F.col("o_custkey") == 1, F.lit("Public")).otherwise(
            X.name("n", F.col("o_custkey") + 200)).alias("name"))
    low = X.table(spark, d, "orders").select(X.name("n", F.col("o_custkey") - 100).alias("name"))
    both = names.unionByName(low)
    free = N.resolve_kinds(both, _principals(spark, d), allow_public=True).withColumn("mode", F.lit("free"))
    forced = N.resolve_kinds(both, _principals(spark, d), "role").withColumn("mode", F.lit("role"))
    return free.unionByName(forced)


def _held(spark, d):
    o = X.table(spark, d, "orders")
    users = X.table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), X.name("c", "c_custkey").alias("user_name"))
    return N.held_grants(
        o.select(X.name("r", F.col("o_orderkey") % 10).alias("role"), X.name("c", "o_custkey").alias("user_name")),
        X.role_members(spark, d), R.group_members(_groups(spark, d), users))


def _grant_plan(spark, d):
    """Each order asks for two roles to be granted to two grantees."""
    o = X.table(spark, d, "orders")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    requests = o.select(
        key.alias("request_id"),
        F.when(key % 3 == 0, "redshift").otherwise("postgresql").alias("engine"),
        F.array(X.name("n", key % 40), X.name("n", cust)).alias("roles"),
        F.array(X.name("n", cust + 1), X.name("n", X.half("o_custkey", 3)), X.name("x", cust % 50)).alias("grantees"))
    held = X.table(spark, d, "customer").select(
        X.name("n", "c_custkey").alias("role"), X.name("n", F.col("c_custkey") + 1).alias("grantee"))
    return N.grant_plan(requests, _principals(spark, d), held, create_missing_users=True).withColumn(
        "reason", F.coalesce("reason", F.lit("")))


def _handover(spark, d):
    leavers = X.table(spark, d, "supplier").select(
        X.name("wh", F.col("s_suppkey") % 3).alias("target"), X.name("c", "s_suppkey").alias("name"))
    member = X.table(spark, d, "customer").select(
        X.name("wh", F.col("c_custkey") % 3).alias("target"), X.name("c", "c_custkey").alias("owner"),
        X.name("g", "c_nationkey").alias("group_name"))
    defaults = X.table(spark, d, "nation").select(
        X.name("wh", F.col("n_nationkey") + 1).alias("target"), F.lower("n_name").alias("new_owner"))
    return N.handover_plan(leavers, X.namespaces(spark, d), X.relations(spark, d), member, defaults)


def _describe(spark, d):
    return R.describe_roles(_roles(spark, d), X.role_members(spark, d), X.acl(spark, d),
                            X.relations(spark, d), X.namespaces(spark, d))


def _superusers(spark, d):
    return _roles(spark, d).where("superuser").select("role")


def _describe_some(spark, d):
    return R.describe_roles(_roles(spark, d), X.role_members(spark, d), X.acl(spark, d),
                            X.relations(spark, d), X.namespaces(spark, d), only=_superusers(spark, d))


QUERIES = {
    "e1_ancestors_of": lambda s, d: R.ancestors(X.role_members(s, d), _superusers(s, d)),
    "e1_ancestors": lambda s, d: R.ancestors(X.role_members(s, d)),
    "e2_descendants": lambda s, d: R.descendants(X.role_members(s, d)),
    "e3_group_members": _group_members,
    "e4_privilege_closure": _closure_set,
    "e5_effective_privileges": lambda s, d: R.effective_privileges(_holders(s, d), X.acl(s, d)),
    "e5_direct_privileges": lambda s, d: R.effective_privileges(_holders(s, d, True), X.acl(s, d)),
    "e6_schema_privilege_matrix": lambda s, d: R.schema_privilege_matrix(_holders(s, d), X.schema_acl(s, d)),
    "e7_owned_summary": lambda s, d: R.owned_summary(X.relations(s, d), X.namespaces(s, d)),
    "e8_effective_defaults": lambda s, d: R.effective_defaults(_holders(s, d), _default_acl(s, d)),
    "e9_role_roster": lambda s, d: R.role_roster(_roles(s, d), X.role_members(s, d), _groups(s, d)),
    "e10_role_attributes": _attributes,
    "e11_resolve_kinds": _kinds,
    "e12_held_grants": _held,
    "e13_grant_plan": _grant_plan,
    "e14_handover_plan": _handover,
    "e15_describe_roles": _describe,
    "e15_describe_some_roles": _describe_some,
}

_HOLD = """
, holders AS (
  SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS role, concat('c', CAST(c_custkey AS VARCHAR)) AS holder FROM customer
  UNION ALL SELECT member, role FROM fx_ancestors WHERE inherit)
"""
_PRIN = """
SELECT concat('n', CAST(c_custkey AS VARCHAR)) AS name, 'user' AS kind FROM customer
UNION ALL SELECT concat('n', CAST(s_suppkey * 3 AS VARCHAR)), 'role' FROM supplier
UNION ALL SELECT concat('n', CAST(n_nationkey * 9 AS VARCHAR)), 'group' FROM nation"""
_GROUP_ROWS = """
SELECT DISTINCT concat('g', CAST(o_orderkey AS VARCHAR)) AS group_name, user_id FROM (
  SELECT o_orderkey, o_custkey AS user_id FROM orders
  UNION ALL SELECT o_orderkey, CAST(floor(o_custkey / 2) AS BIGINT) FROM orders) g"""
_DEFAULTS = """
SELECT concat('c', CAST(o_custkey % 10 AS VARCHAR)) AS owner,
       CASE WHEN o_orderkey % 3 <> 0 THEN concat('s', CAST(CAST(floor(o_orderkey / 20) AS BIGINT) AS VARCHAR)) ELSE '' END AS schema_name,
       CASE o_orderkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'sequence' WHEN 2 THEN 'function' WHEN 3 THEN 'type' ELSE 'n' END AS object_type,
       CASE WHEN o_custkey % 19 <> 0 THEN concat('c', CAST(o_custkey AS VARCHAR)) END AS grantee,
       o_orderstatus AS privilege, o_totalprice > 300000 AS grantable FROM orders"""
_OWNED = """
SELECT target, owner, schema_name, kind, objects, CAST(sum(objects) OVER (PARTITION BY target, owner) AS BIGINT) AS total_relations
FROM (SELECT target, owner, schema_name, CASE relkind WHEN 'r' THEN 'table' WHEN 'p' THEN 'table' WHEN 'v' THEN 'view'
        WHEN 'm' THEN 'matview' WHEN 'S' THEN 'sequence' END AS kind, count(*) AS objects
      FROM fx_relations GROUP BY 1, 2, 3, 4) c
UNION ALL SELECT target, owner, schema_name, 'schema', 1, NULL FROM fx_namespaces WHERE owner IS NOT NULL"""


def _effective(fx: str, grants: str, columns: str, direct: bool = False) -> str:
    names = fx if direct else f"{fx} fx_ancestors"
    head = with_fx(names, "")
    hold = _HOLD if not direct else """
, holders AS (SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS role, concat('c', CAST(c_custkey AS VARCHAR)) AS holder FROM customer)"""
    return head + hold + f"""
SELECT h.role, g.grantee AS via, {columns} FROM holders h JOIN {grants} g ON g.grantee = h.holder
UNION ALL SELECT 'public', 'public', {columns} FROM {grants} g WHERE g.grantee IS NULL"""


ORACLE = {
    "e1_ancestors": with_fx("fx_ancestors", "SELECT member, role, depth, inherit, via FROM fx_ancestors"),
    "e2_descendants": with_fx("fx_role_members", "") + """
, down AS (
  SELECT role, member, 1 AS depth, role AS via, inherit FROM fx_role_members
  UNION SELECT w.role, e.member, w.depth + 1, w.member, w.inherit AND e.inherit
  FROM down w JOIN fx_role_members e ON e.role = w.member WHERE w.depth < 60)
SELECT role, member, CAST(min(depth) AS INTEGER) AS depth, bool_or(inherit) AS inherit,
       min(via) FILTER (WHERE depth = first_depth) AS via
FROM (SELECT *, min(depth) OVER (PARTITION BY role, member) AS first_depth FROM down) w
WHERE member <> role GROUP BY role, member""",
    "e3_group_members": f"""
SELECT group_name, user_id, c_name AS user_name FROM ({_GROUP_ROWS}) m JOIN customer ON c_custkey = user_id""",
    "e4_privilege_closure": with_fx("fx_ancestors", "") + _HOLD + """
SELECT role, holder FROM holders
UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR)), 'public' FROM customer""",
    "e5_effective_privileges": _effective(
        "fx_acl", "fx_acl", "g.scope, g.object_name, g.privilege, g.grantor, g.grantable"),
    "e5_direct_privileges": _effective(
        "fx_acl", "fx_acl", "g.scope, g.object_name, g.privilege, g.grantor, g.grantable", True),
    "e6_schema_privilege_matrix": f"""
SELECT role, schema_name, bool_or(privilege = 'USAGE') AS can_use, bool_or(privilege = 'CREATE') AS can_create
FROM ({_effective("fx_schema_acl", "fx_schema_acl", "g.schema_name, g.privilege")}) e
WHERE privilege IN ('USAGE', 'CREATE') GROUP BY role, schema_name""",
    "e7_owned_summary": with_fx("fx_relations fx_namespaces", _OWNED),
    "e8_effective_defaults": _effective(
        "", f"({_DEFAULTS})", "g.owner, g.schema_name, g.object_type, g.privilege, g.grantable"),
    "e9_role_roster": with_fx("fx_role_members", """
SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS name, c_acctbal > 0 AS can_login, c_acctbal > 9000 AS superuser,
       c_nationkey % 2 = 0 AS create_db, c_nationkey % 3 = 0 AS create_role,
       (SELECT count(*) FROM fx_role_members e WHERE e.member = concat('c', CAST(c_custkey AS VARCHAR))) AS parents,
       (SELECT count(*) FROM fx_role_members e WHERE e.role = concat('c', CAST(c_custkey AS VARCHAR))) AS members
FROM customer
UNION ALL SELECT concat('g', CAST(o_orderkey AS VARCHAR)), FALSE, FALSE, FALSE, FALSE, 0, 2 FROM orders"""),
    "e10_role_attributes": """
WITH a AS (
  SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS role, c_mktsegment = 'MACHINERY' AS g, c_custkey AS k, c_acctbal AS b,
         c_nationkey AS n FROM customer),
f AS (SELECT *, CASE WHEN g THEN '' ELSE concat_ws(' · ', CASE WHEN b > 9000 THEN 'SUPERUSER' END,
         CASE WHEN k % 2 = 0 THEN 'CREATEDB' END, CASE WHEN k % 3 = 0 THEN 'CREATEROLE' END,
         CASE WHEN k % 5 = 0 THEN 'REPLICATION' END, CASE WHEN k % 7 = 0 THEN 'BYPASSRLS' END,
         CASE WHEN k % 4 = 0 THEN 'NOINHERIT' END) END AS flags FROM a)
SELECT 'readable' AS store, role, NOT g AND b > 0 AS can_login, CASE WHEN g THEN -1 ELSE 10 END AS connection_limit,
       NOT g AND b > 1000 AND n > 5 AS password_set, flags FROM f
UNION ALL SELECT 'unreadable', role, NOT g AND b > 0, CASE WHEN g THEN -1 ELSE 10 END,
       CASE WHEN g THEN FALSE END, flags FROM f""",
    "e11_resolve_kinds": f"""
WITH names AS (
  SELECT DISTINCT name FROM (
    SELECT CASE WHEN o_custkey = 1 THEN 'Public' ELSE concat('n', CAST(o_custkey + 200 AS VARCHAR)) END AS name FROM orders
    UNION ALL SELECT concat('n', CAST(o_custkey - 100 AS VARCHAR)) FROM orders) n),
k AS (
  SELECT n.name, bool_or(p.kind = 'user') AS u, bool_or(p.kind = 'group') AS g, bool_or(p.kind = 'role') AS r,
         count(DISTINCT p.kind) AS c, max(p.kind) AS any_kind
  FROM names n LEFT JOIN ({_PRIN}) p ON p.name = n.name GROUP BY n.name),
l AS (SELECT *, concat_ws(', ', CASE WHEN u THEN 'user' END, CASE WHEN g THEN 'group' END, CASE WHEN r THEN 'role' END) AS found FROM k)
SELECT name, 'free' AS mode, found, CASE WHEN name = 'Public' THEN 'role' WHEN c = 1 THEN any_kind END AS kind,
       CASE WHEN name = 'Public' THEN 'ok' WHEN c = 0 THEN 'absent' WHEN c > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM l
UNION ALL SELECT name, 'role', found, CASE WHEN r AND name <> 'Public' THEN 'role' END,
       CASE WHEN name = 'Public' THEN 'public_not_allowed' WHEN c = 0 THEN 'absent' WHEN r THEN 'ok' ELSE 'not_that_kind' END FROM l""",
    "e12_held_grants": with_fx("fx_role_members", f"""
SELECT concat('r', CAST(o_orderkey % 10 AS VARCHAR)) AS role, concat('c', CAST(o_custkey AS VARCHAR)) AS grantee FROM orders
UNION SELECT role, member FROM fx_role_members
UNION SELECT group_name, concat('c', CAST(user_id AS VARCHAR)) FROM ({_GROUP_ROWS}) g JOIN customer ON c_custkey = user_id"""),
    "e13_grant_plan": f"""
WITH prin AS (SELECT name, min(kind) AS kind FROM ({_PRIN}) p GROUP BY name),
pairs AS (
  SELECT DISTINCT o_orderkey AS request_id, o_orderkey % 3 = 0 AS rs, concat('n', CAST(r.v AS VARCHAR)) AS role, t.v AS grantee
  FROM orders, LATERAL (SELECT unnest([o_orderkey % 40, o_custkey]) AS v) r,
       LATERAL (SELECT unnest([concat('n', CAST(o_custkey + 1 AS VARCHAR)),
                concat('n', CAST(CAST(floor(o_custkey / 3) AS BIGINT) AS VARCHAR)), concat('x', CAST(o_custkey % 50 AS VARCHAR))]) AS v) t),
j AS (
  SELECT p.*, a.kind AS role_kind, b.kind IS NULL AS absent, coalesce(b.kind, 'user') AS grantee_kind, h.c_custkey IS NOT NULL AS held
  FROM pairs p LEFT JOIN prin a ON a.name = p.role LEFT JOIN prin b ON b.name = p.grantee
  LEFT JOIN customer h ON p.role = concat('n', CAST(h.c_custkey AS VARCHAR)) AND p.grantee = concat('n', CAST(h.c_custkey + 1 AS VARCHAR))),
r AS (
  SELECT *, CASE WHEN role_kind IS NULL THEN 'role not found'
    WHEN role_kind = 'user' AND rs THEN 'a login user holds no members here'
    WHEN role_kind = 'group' AND grantee_kind = 'role' THEN 'a group holds users only'
    WHEN role_kind = 'role' AND grantee_kind = 'group' THEN 'a group takes no roles' ELSE '' END AS reason FROM j)
SELECT request_id, role, role_kind, grantee, grantee_kind, reason,
       CASE WHEN reason = 'role not found' THEN 'error' WHEN reason <> '' THEN 'invalid' WHEN held THEN 'already_held'
            WHEN absent THEN 'create_user_and_grant' ELSE 'grant' END AS action FROM r""",
    "e14_handover_plan": with_fx("fx_relations fx_namespaces", """
, leavers AS (SELECT concat('wh', CAST(s_suppkey % 3 AS VARCHAR)) AS target, concat('c', CAST(s_suppkey AS VARCHAR)) AS name FROM supplier),
owned AS (
  SELECT l.target, l.name, 1 AS phase, concat('SCHEMA "', schema_name, '"') AS object
  FROM fx_namespaces n JOIN leavers l ON l.target = n.target AND l.name = n.owner
  UNION ALL
  SELECT l.target, l.name, 2, concat(CASE WHEN relkind = 'v' THEN 'VIEW "' ELSE 'TABLE "' END, schema_name, '"."', relation_name, '"')
  FROM fx_relations r JOIN leavers l ON l.target = r.target AND l.name = r.owner WHERE relkind IN ('r', 'v'))
SELECT o.target, name, phase, CASE WHEN n_name IS NULL THEN 'error' ELSE 'reassign' END AS action,
       CASE WHEN n_name IS NULL THEN concat('no new owner for ', object)
            ELSE concat('ALTER ', object, ' OWNER TO "', lower(n_name), '";') END AS statement
FROM owned o LEFT JOIN nation ON o.target = concat('wh', CAST(n_nationkey + 1 AS VARCHAR))
UNION ALL
SELECT target, name, 3, 'leave', concat('ALTER GROUP "g', CAST(c_nationkey AS VARCHAR), '" DROP USER "', name, '";')
FROM leavers JOIN customer ON name = concat('c', CAST(c_custkey AS VARCHAR)) AND target = concat('wh', CAST(c_custkey % 3 AS VARCHAR))
UNION ALL SELECT target, name, 4, 'drop', concat('DROP USER "', name, '";') FROM leavers"""),
    "e15_describe_roles": with_fx("fx_ancestors fx_acl fx_relations fx_namespaces", "") + _HOLD + f"""
SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS role, 'login' AS section, 'can_login' AS item,
       CAST(c_acctbal > 0 AS VARCHAR) AS detail FROM customer
UNION ALL SELECT member, 'member_of', role, concat('depth ', depth, ' via ', via, CASE WHEN inherit THEN ' inherit' ELSE ' no inherit' END) FROM fx_ancestors
UNION ALL SELECT role, 'members', member, concat('depth ', depth, CASE WHEN inherit THEN ' inherit' ELSE ' no inherit' END) FROM fx_ancestors
UNION ALL SELECT h.role, 'privileges', concat(scope, ':', object_name), concat(privilege, ' via ', grantee)
  FROM holders h JOIN fx_acl ON grantee = holder
UNION ALL SELECT 'public', 'privileges', concat(scope, ':', object_name), concat(privilege, ' via public') FROM fx_acl WHERE grantee IS NULL
UNION ALL SELECT owner, 'owns', concat(target, '.', schema_name), concat(objects, ' ', kind) FROM ({_OWNED}) o""",
}

_SUPER = "SELECT concat('c', CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_acctbal > 9000"
ORACLE["e1_ancestors_of"] = ORACLE["e1_ancestors"] + f" WHERE member IN ({_SUPER})"
ORACLE["e15_describe_some_roles"] = (
    f"SELECT * FROM ({ORACLE['e15_describe_roles']}) WHERE role = 'public' OR role IN ({_SUPER})"
)
