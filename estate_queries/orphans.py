"""Orphaned models, renames, reverts and purges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from estate.operators import orphans as O
from estate.session import materialize
from estate_queries import fixtures as X
from estate_queries.fixtures import with_fx

SINCE = datetime(2000, 1, 1)
PURGE_DAY = datetime(2001, 9, 29)
REDSHIFT = ("wh1",)


def _live(spark, d, args=None):
    return O.live_models(X.model_runs(spark, d), X.invocations(spark, d), "my_project", SINCE, args)


def _current(spark, d):
    return X.relations(spark, d).select(
        "relation_id", "target", "schema_name", "relation_name", "relkind")


def _existing(spark, d, live=None):
    live = _live(spark, d) if live is None else live
    return O.existing_relations(_current(spark, d), X.inherits(spark, d), live, REDSHIFT)


def _orphans(spark, d):
    live = _live(spark, d)
    tokens = ["dev_economy", "prod_small.t7  # kept by finance"]
    return O.orphans(_existing(spark, d, live), live, tokens)


def _summary(spark, d):
    live = materialize(_live(spark, d), "live")
    existing = materialize(_existing(spark, d, live), "existing")
    return O.orphan_summary(live, existing, O.orphans(existing, live))


def _later(spark, d):
    """The snapshot when the plan is made: small parts are gone, some names are taken."""
    gone = X.table(spark, d, "part").where("p_size < 6").select(F.col("p_partkey").alias("relation_id"))
    now = _current(spark, d).join(gone, "relation_id", "left_anti")
    taken = X.table(spark, d, "part").where("p_size % 4 = 0").select(
        F.lit(-1).cast("bigint").alias("relation_id"), X.part_target().alias("target"),
        X.part_schema().alias("schema_name"),
        F.concat(X.name("t", "p_partkey"), F.lit("_deprecated")).alias("relation_name"),
        F.lit("r").alias("relkind"))
    return now.unionByName(taken.join(now, ["target", "schema_name", "relation_name"], "left_anti")
                           .select(*now.columns))


def _rename(spark, d):
    return O.rename_plan(_orphans(spark, d), _later(spark, d), REDSHIFT).withColumn(
        "statement", F.coalesce("statement", F.lit("")))


def _revert(spark, d):
    log = X.rename_log(spark, d).withColumn(
        "old_name", F.when(F.col("old_name") != "t22", F.col("old_name")))
    return O.revert_plan(log, _later(spark, d), REDSHIFT)


def _deprecated(spark, d):
    return O.deprecated_objects(_current(spark, d), X.inherits(spark, d))


def _plan(spark, d, unknown=False):
    return O.purge_plan(_deprecated(spark, d), O.renamed_at(X.rename_log(spark, d)), PURGE_DAY, 90, unknown)


def _blocked(spark, d):
    plan = materialize(_plan(spark, d, True), "purge")
    return O.blocked_drops(plan, X.edges(spark, d), _current(spark, d))


def _decision(spark, d):
    plan = materialize(_plan(spark, d, True).where(F.col("kind") != "matview"), "purge")
    blocked = materialize(O.blocked_drops(plan, X.edges(spark, d), _current(spark, d)), "blocked")
    return O.purge_decision(plan, blocked)


QUERIES = {
    "o1_live_models": _live,
    "o1_live_models_by_args": lambda s, d: _live(s, d, "build high"),
    "o2_existing_relations": _existing,
    "o3_orphans": _orphans,
    "o4_orphan_summary": _summary,
    "o5_rename_plan": _rename,
    "o6_revert_plan": _revert,
    "o7_renamed_at": lambda s, d: O.renamed_at(X.rename_log(s, d)),
    "o8_deprecated_objects": _deprecated,
    "o9_purge_plan": _plan,
    "o10_blocked_drops": _blocked,
    "o10_purge_decision": _decision,
}

_LIVE = """
live AS (
  SELECT DISTINCT target, schema_name, name AS relation_name FROM fx_model_runs m
  JOIN fx_invocations i ON i.invocation_id = m.invocation_id
  WHERE i.command = 'build' AND i.run_started_at >= TIMESTAMP '2000-01-01 00:00:00' {args}
    AND starts_with(m.node_id, 'model.my_project.') AND m.status IN ('success', 'error'))"""
_STAND = """
alone AS (
  SELECT relation_id, target, schema_name, relation_name, relkind,
         CASE relkind WHEN 'v' THEN 'view' WHEN 'm' THEN 'matview' ELSE 'table' END AS kind
  FROM fx_relations r WHERE relkind <> 'S' {redshift}
    AND NOT EXISTS (SELECT 1 FROM fx_inherits h JOIN fx_relations p ON p.relation_id = h.parent_id
                    WHERE h.child_id = r.relation_id AND p.relkind = 'p' {rule}))"""
_RS = _STAND.format(redshift="AND NOT (target = 'wh1' AND relkind = 'm')", rule="AND p.target <> 'wh1'")
_ALL = _STAND.format(redshift="", rule="")
_EXIST = """
existing AS (SELECT * FROM alone a WHERE EXISTS (SELECT 1 FROM live l WHERE l.target = a.target AND l.schema_name = a.schema_name))"""
_ORPH = """
orph AS (
  SELECT * FROM existing e WHERE right(relation_name, 11) <> '_deprecated' {tokens}
    AND NOT EXISTS (SELECT 1 FROM live l WHERE l.target = e.target AND l.schema_name = e.schema_name AND l.relation_name = e.relation_name))"""
_TOKENS = "AND schema_name <> 'dev_economy' AND NOT (schema_name = 'prod_small' AND relation_name = 't7')"
_LATER = """
kept AS (SELECT relation_id, target, schema_name, relation_name, relkind FROM fx_relations
         WHERE relation_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 6)),
later AS (
  SELECT target, schema_name, relation_name, relkind FROM kept
  UNION ALL SELECT r.target, r.schema_name, concat('t', CAST(relation_id AS VARCHAR), '_deprecated'), 'r'
  FROM fx_relations r JOIN part ON p_partkey = relation_id AND p_size % 4 = 0
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.target = r.target AND k.schema_name = r.schema_name
                    AND k.relation_name = concat('t', CAST(r.relation_id AS VARCHAR), '_deprecated'))),
objects AS (SELECT *, CASE relkind WHEN 'v' THEN 'view' WHEN 'm' THEN 'matview' ELSE 'table' END AS kind
            FROM later WHERE relkind <> 'S')"""
_PURGE = """
dep AS (SELECT relation_id, target, schema_name, relation_name, kind FROM alone
        WHERE right(relation_name, 11) = '_deprecated' AND left(schema_name, 3) <> 'pg_'),
done AS (SELECT target, schema_name, new_name AS relation_name, max(generated_at) AS renamed_at
       FROM fx_rename_log WHERE NOT dry_run GROUP BY 1, 2, 3),
plan AS (
  SELECT d.*, a.renamed_at, CASE WHEN a.renamed_at IS NULL THEN 'unknown'
         WHEN a.renamed_at <= TIMESTAMP '2001-07-01 00:00:00' THEN 'due' ELSE 'grace' END AS reason
  FROM dep d LEFT JOIN done a ON a.target = d.target AND a.schema_name = d.schema_name AND a.relation_name = d.relation_name)"""
_BLOCK = """
todo AS (SELECT * FROM plan WHERE reason IN ('due', 'unknown') {kinds}),
blocked AS (
  SELECT DISTINCT t.relation_id, t.target, t.schema_name, t.relation_name, t.kind,
         concat(CASE v.relkind WHEN 'v' THEN 'view' ELSE 'matview' END, ' "', v.schema_name, '"."', v.relation_name, '"') AS dependent
  FROM todo t JOIN lineitem ON l_partkey = t.relation_id AND l_suppkey <> l_partkey
  JOIN fx_relations v ON v.relation_id = l_suppkey AND v.relkind IN ('v', 'm')
  WHERE l_suppkey NOT IN (SELECT relation_id FROM todo))"""


def _sql(fx: str, *parts: str, body: str) -> str:
    return with_fx(fx, "").rstrip() + "," + ",".join(parts) + body


_LIVE_FX = "fx_model_runs fx_invocations"
_ALL_FX = f"{_LIVE_FX} fx_relations fx_inherits"
_LIVE_ALL = _LIVE.format(args="")

ORACLE = {
    "o1_live_models": _sql(_LIVE_FX, _LIVE_ALL, body=" SELECT * FROM live"),
    "o1_live_models_by_args": _sql(
        _LIVE_FX, _LIVE.format(args="AND contains(i.invocation_args, '\"invocation_command\": \"build high\"')"),
        body=" SELECT * FROM live"),
    "o2_existing_relations": _sql(_ALL_FX, _LIVE_ALL, _RS, _EXIST, body=" SELECT * FROM existing"),
    "o3_orphans": _sql(_ALL_FX, _LIVE_ALL, _RS, _EXIST, _ORPH.format(tokens=_TOKENS), body=" SELECT * FROM orph"),
    "o4_orphan_summary": _sql(_ALL_FX, _LIVE_ALL, _RS, _EXIST, _ORPH.format(tokens=""), body="""
SELECT l.target, l.schema_name, l.n AS live, coalesce(e.n, 0) AS existing, coalesce(o.n, 0) AS orphans
FROM (SELECT target, schema_name, count(*) AS n FROM live GROUP BY 1, 2) l
LEFT JOIN (SELECT target, schema_name, count(*) AS n FROM existing GROUP BY 1, 2) e USING (target, schema_name)
LEFT JOIN (SELECT target, schema_name, count(*) AS n FROM orph GROUP BY 1, 2) o USING (target, schema_name)"""),
    "o5_rename_plan": _sql(_ALL_FX, _LIVE_ALL, _RS, _EXIST, _ORPH.format(tokens=_TOKENS), _LATER, body="""
SELECT o.target, o.schema_name, o.relation_name, o.new_name, c.kind,
       CASE WHEN c.kind IS NULL THEN 'skip:vanished' WHEN n.kind IS NOT NULL THEN 'skip:collision' ELSE 'rename' END AS action,
       CASE WHEN c.kind IS NOT NULL AND n.kind IS NULL THEN concat(
         CASE WHEN o.target = 'wh1' OR c.kind = 'table' THEN 'ALTER TABLE' WHEN c.kind = 'view' THEN 'ALTER VIEW' ELSE 'ALTER MATERIALIZED VIEW' END,
         ' "', o.schema_name, '"."', o.relation_name, '" RENAME TO "', o.new_name, '";') ELSE '' END AS statement
FROM (SELECT target, schema_name, relation_name, concat(relation_name, '_deprecated') AS new_name FROM orph) o
LEFT JOIN objects c ON c.target = o.target AND c.schema_name = o.schema_name AND c.relation_name = o.relation_name
LEFT JOIN objects n ON n.target = o.target AND n.schema_name = o.schema_name AND n.relation_name = o.new_name"""),
    "o6_revert_plan": _sql("fx_relations fx_rename_log", _LATER, body="""
, log AS (SELECT target, schema_name, CASE WHEN old_name <> 't22' THEN old_name END AS old_name, new_name, bool_and(dry_run) AS dry_run
          FROM fx_rename_log GROUP BY 1, 2, 3, 4),
p AS (
  SELECT g.*, n.kind, CASE WHEN g.old_name IS NULL THEN 'skip:malformed' WHEN n.kind IS NULL THEN 'skip:not_found'
         WHEN c.kind IS NOT NULL THEN 'skip:old_name_taken' ELSE 'revert' END AS action
  FROM log g LEFT JOIN objects n ON n.target = g.target AND n.schema_name = g.schema_name AND n.relation_name = g.new_name
  LEFT JOIN objects c ON c.target = g.target AND c.schema_name = g.schema_name AND c.relation_name = g.old_name)
SELECT target, schema_name, old_name, new_name, dry_run, action,
       CASE WHEN action = 'revert' THEN concat(
         CASE WHEN target = 'wh1' OR kind = 'table' THEN 'ALTER TABLE' WHEN kind = 'view' THEN 'ALTER VIEW' ELSE 'ALTER MATERIALIZED VIEW' END,
         ' "', schema_name, '"."', new_name, '" RENAME TO "', old_name, '";') END AS statement
FROM p"""),
    "o7_renamed_at": with_fx("fx_rename_log", """
SELECT target, schema_name, new_name AS relation_name, max(generated_at) AS renamed_at
FROM fx_rename_log WHERE NOT dry_run GROUP BY 1, 2, 3"""),
    "o8_deprecated_objects": _sql("fx_relations fx_inherits", _ALL, body="""
 SELECT relation_id, target, schema_name, relation_name, kind FROM alone
 WHERE right(relation_name, 11) = '_deprecated' AND left(schema_name, 3) <> 'pg_'"""),
    "o9_purge_plan": _sql("fx_relations fx_inherits fx_rename_log", _ALL, _PURGE, body="""
 SELECT *, reason = 'due' AS "drop" FROM plan"""),
    "o10_blocked_drops": _sql("fx_relations fx_inherits fx_rename_log", _ALL, _PURGE, _BLOCK.format(kinds=""), body=" SELECT * FROM blocked"),
    "o10_purge_decision": _sql(
        "fx_relations fx_inherits fx_rename_log", _ALL, _PURGE, _BLOCK.format(kinds="AND kind <> 'matview'"), body="""
, n AS (SELECT relation_id, count(*) AS dependents FROM blocked GROUP BY 1)
SELECT t.relation_id, t.target, t.schema_name, t.relation_name, t.kind, coalesce(n.dependents, 0) AS dependents,
       CASE WHEN n.dependents > 0 THEN 'blocked' WHEN t.target IN (SELECT target FROM blocked) THEN 'held_back' ELSE 'drop' END AS decision,
       CASE WHEN n.dependents IS NULL AND t.target NOT IN (SELECT target FROM blocked)
            THEN concat(CASE kind WHEN 'table' THEN 'DROP TABLE' WHEN 'view' THEN 'DROP VIEW' ELSE 'DROP MATERIALIZED VIEW' END,
                        ' IF EXISTS "', schema_name, '"."', relation_name, '";') END AS statement
FROM todo t LEFT JOIN n ON n.relation_id = t.relation_id"""),
}
