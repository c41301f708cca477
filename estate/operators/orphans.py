"""Relations no model run produces any more: find, set aside, restore, purge.

Relations are ``(relation_id, target, schema_name, relation_name, relkind)``.
Plans are rows; nothing is renamed or dropped here.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.functions import predicates as P
from estate.functions import text as T
from estate.functions.times import at
from estate.plans.shapes import hot_join

SUFFIX = "_deprecated"
# Schemas no scan looks at unless told otherwise, states of a live run.
SKIPPED_SCHEMAS = ("raw", "_raw", "dbt_artifacts")
LIVE_STATES = ("success", "error")

_NAME = ["target", "schema_name", "relation_name"]
_TABLES = ("r", "p", "f")


def live_models(
    runs: DataFrame,
    invocations: DataFrame,
    project: str,
    since: datetime,
    invocation_command: str | None = None,
) -> DataFrame:
    """Distinct models built by any qualifying invocation since a point in time.

    The project prefix is literal, and both inputs are filtered before the join.
    """
    chosen = invocations.where(
        (F.col("command") == "build") & (F.col("run_started_at") >= at(since))
    )
    if invocation_command:
        wanted = f'"invocation_command": "{invocation_command}"'
        chosen = chosen.where(F.contains("invocation_args", F.lit(wanted)))
    models = runs.where(
        F.col("node_id").startswith(f"model.{project}.") & F.col("status").isin(*LIVE_STATES)
    )
    return (
        models.join(chosen.select("invocation_id"), "invocation_id", "left_semi")
        .select("target", "schema_name", F.col("name").alias("relation_name"))
        .distinct()
    )


def partition_children(relations: DataFrame, inherits: DataFrame) -> DataFrame:
    """Ids of relations whose parent is a partitioned table."""
    parents = relations.where(F.col("relkind") == "p").select(F.col("relation_id").alias("parent_id"))
    children = hot_join(inherits, parents, ["parent_id"], "left_semi", by=["child_id"])
    return children.select(F.col("child_id").alias("relation_id"))


def object_kind(kind: str = "relkind") -> Column:
    """table, view or matview; NULL for what is none of them."""
    code = F.col(kind)
    return (
        F.when(code.isin(*_TABLES), F.lit("table"))
        .when(code == "v", F.lit("view"))
        .when(code == "m", F.lit("matview"))
    )


def standalone(
    relations: DataFrame, inherits: DataFrame, no_matviews: Sequence[str] = ()
) -> DataFrame:
    """Tables, views and matviews that are no partition children, with their kind.

    ``no_matviews`` names targets whose engine lists no matviews and has no
    declarative partitions; the partition rule does not apply there.
    """
    plain = F.col("target").isin(*no_matviews) if no_matviews else F.lit(False)
    kept = relations.withColumn("kind", object_kind()).where(
        F.col("kind").isNotNull() & ~(plain & (F.col("kind") == "matview"))
    )
    children = partition_children(relations.where(~plain), inherits)
    return kept.join(children, "relation_id", "left_anti")


def existing_relations(
    relations: DataFrame, inherits: DataFrame, live: DataFrame, no_matviews: Sequence[str] = ()
) -> DataFrame:
    """Standalone relations in schemas where something is live."""
    schemas = live.select("target", "schema_name").distinct()
    found = standalone(relations, inherits, no_matviews)
    return hot_join(found, schemas, ["target", "schema_name"], "left_semi", by=["relation_id"])


def orphans(
    existing: DataFrame,
    live: DataFrame,
    exclusions: Iterable[str] | DataFrame = (),
    skipped: Sequence[str] = SKIPPED_SCHEMAS,
) -> DataFrame:
    """Existing relations that are not live.

    ``existing`` holds only schemas with live models, so a target without any
    live model yields nothing rather than everything.
    """
    candidates = existing.where(
        ~F.col("schema_name").isin(*skipped) & ~F.col("relation_name").endswith(SUFFIX)
    )
    return P.exclude(candidates, exclusions).join(live, _NAME, "left_anti")


def orphan_summary(live: DataFrame, existing: DataFrame, found: DataFrame) -> DataFrame:
    """Live, existing and orphaned relations per schema, from one aggregation."""
    keys = ["target", "schema_name"]
    marked = [
        df.select(*keys, *[F.lit(int(i == j)).alias(c) for j, c in enumerate(("l", "e", "o"))])
        for i, df in enumerate((live, existing, found))
    ]
    return marked[0].unionByName(marked[1]).unionByName(marked[2]).groupBy(*keys).agg(
        F.sum("l").alias("live"), F.sum("e").alias("existing"), F.sum("o").alias("orphans")
    )


def _rename(kind: Column, old: Column, new: Column, tables_only: Column) -> Column:
    word = (
        F.when(tables_only | (kind == "table"), F.lit("ALTER TABLE "))
        .when(kind == "view", F.lit("ALTER VIEW "))
        .otherwise(F.lit("ALTER MATERIALIZED VIEW "))
    )
    return F.concat(word, T.quote("schema_name"), F.lit("."), T.quote(old), F.lit(" RENAME TO "),
                    T.quote(new), F.lit(";"))


def _looked_up(entries: DataFrame, current: DataFrame, kept: str, freed: str) -> DataFrame:
    """``entries`` with the ``kind`` of the object named ``kept`` and whether ``freed`` is ``_taken``.

    Both names of an entry go into one lookup, so ``current`` is read once.
    """
    now = current.select("target", "schema_name", F.col("relation_name").alias("_name"), object_kind().alias("_kind"))
    both = F.explode(F.array(
        F.struct(F.lit(True).alias("own"), F.col(kept).alias("name")),
        F.struct(F.lit(False).alias("own"), F.col(freed).alias("name")),
    ))
    return (
        entries.withColumn("_side", both).withColumn("_name", F.col("_side.name"))
        .join(now.where("_kind is not null"), ["target", "schema_name", "_name"], "left")
        .groupBy(*entries.columns)
        .agg(F.max(F.when(F.col("_side.own"), F.col("_kind"))).alias("kind"),
             F.max(~F.col("_side.own") & F.col("_kind").isNotNull()).alias("_taken"))
    )


def rename_plan(
    found: DataFrame, current: DataFrame, redshift: Sequence[str] = ()
) -> DataFrame:
    """Set orphans aside under a suffixed name.

    ``action`` is rename, skip:vanished or skip:collision (the new name is taken).
    Targets in ``redshift`` rename everything with ALTER TABLE.
    """
    named = found.select(*_NAME, F.concat("relation_name", F.lit(SUFFIX)).alias("new_name"))
    plan = _looked_up(named, current, "relation_name", "new_name")
    action = (
        F.when(F.col("kind").isNull(), F.lit("skip:vanished"))
        .when(F.col("_taken"), F.lit("skip:collision"))
        .otherwise(F.lit("rename"))
    )
    tables_only = F.col("target").isin(*redshift) if redshift else F.lit(False)
    statement = _rename(F.col("kind"), F.col("relation_name"), F.col("new_name"), tables_only)
    return plan.withColumn("action", action).select(
        *_NAME, "new_name", "kind", "action",
        F.when(F.col("action") == "rename", statement).alias("statement"),
    )


def revert_plan(log: DataFrame, current: DataFrame, redshift: Sequence[str] = ()) -> DataFrame:
    """Undo logged renames.

    ``log`` is ``(target, schema_name, old_name, new_name, dry_run)``, one row per
    entry; entries of the same rename are planned once. ``action`` is revert,
    skip:malformed, skip:not_found or skip:old_name_taken.
    """
    key = ["target", "schema_name", "old_name", "new_name"]
    entries = log.groupBy(*key).agg(F.min("dry_run").alias("dry_run"))
    blank = [F.coalesce(F.col(c), F.lit("")) == "" for c in key[1:]]
    action = (
        F.when(blank[0] | blank[1] | blank[2], F.lit("skip:malformed"))
        .when(F.col("kind").isNull(), F.lit("skip:not_found"))
        .when(F.col("_taken"), F.lit("skip:old_name_taken"))
        .otherwise(F.lit("revert"))
    )
    tables_only = F.col("target").isin(*redshift) if redshift else F.lit(False)
    statement = _rename(F.col("kind"), F.col("new_name"), F.col("old_name"), tables_only)
    return (
        _looked_up(entries, current, "new_name", "old_name")
        .withColumn("action", action)
        .select(*key, "dry_run", "action",
                F.when(F.col("action") == "revert", statement).alias("statement"))
    )


def renamed_at(log: DataFrame) -> DataFrame:
    """Newest applied rename per object, over all runs."""
    whole = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("target", "schema_name", "new_name")]
    return (
        log.where(~F.col("dry_run") & whole[0] & whole[1] & whole[2])
        .groupBy("target", "schema_name", F.col("new_name").alias("relation_name"))
        .agg(F.max("generated_at").alias("renamed_at"))
    )


def deprecated_objects(
    relations: DataFrame,
    inherits: DataFrame,
    skipped: Sequence[str] = SKIPPED_SCHEMAS,
    no_matviews: Sequence[str] = (),
) -> DataFrame:
    """Suffixed standalone relations outside system and skipped schemas."""
    found = standalone(relations, inherits, no_matviews)
    return (
        P.hide_system(P.with_suffix(found, "relation_name", SUFFIX))
        .where(~F.col("schema_name").isin(*skipped))
        .select("relation_id", *_NAME, "kind")
    )


def purge_plan(
    deprecated: DataFrame,
    renames: DataFrame,
    as_of: datetime,
    older_than_days: int | None = None,
    include_unknown: bool = False,
) -> DataFrame:
    """Which set-aside relations may go: due, in grace, or unknown.

    Without ``older_than_days`` every relation is due. A relation with no recorded
    rename is only dropped on request.
    """
    if older_than_days is None:
        return deprecated.withColumns({
            "renamed_at": F.lit(None).cast("timestamp_ntz"), "reason": F.lit("due"),
            "drop": F.lit(True)})
    cutoff = at(as_of - timedelta(days=older_than_days))
    reason = (
        F.when(F.col("renamed_at").isNull(), F.lit("unknown"))
        .when(F.col("renamed_at") <= cutoff, F.lit("due"))
        .otherwise(F.lit("grace"))
    )
    due = F.col("reason") == "due"
    if include_unknown:
        due = due | (F.col("reason") == "unknown")
    return deprecated.join(renames, _NAME, "left").withColumn("reason", reason).withColumn("drop", due)


def blocked_drops(plan: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per relation to drop and view that still reads it.

    ``edges`` is ``(view_id, source_id)``. Views that go in the same plan do not
    block. A popular relation may have any number of readers, so they stay rows;
    ``dependent`` is the line a report would show.
    """
    drops = plan.where("drop")
    staying = relations.where(F.col("relkind").isin("v", "m")).join(
        drops.select("relation_id"), "relation_id", "left_anti"
    ).select(F.col("relation_id").alias("view_id"),
             F.concat(P.kind_label(), F.lit(" "), T.qualified()).alias("dependent"))
    reads = edges.where(F.col("view_id") != F.col("source_id")).distinct()
    hit = drops.join(reads.withColumnRenamed("source_id", "relation_id"), "relation_id")
    return hot_join(hit, staying, ["view_id"], by=["relation_id"]).select(
        "relation_id", *_NAME, "kind", "dependent"
    )


def purge_decision(plan: DataFrame, blocked: DataFrame) -> DataFrame:
    """The plan under the all-or-nothing rule: one blocked drop holds back its target."""
    per_object = blocked.groupBy("relation_id").agg(F.count("*").alias("dependents"))
    held = blocked.select("target").distinct().withColumn("_held", F.lit(True))
    drops = plan.where("drop").join(per_object, "relation_id", "left")
    joined = hot_join(drops, held, ["target"], "left", by=["relation_id"])
    decision = (
        F.when(F.col("dependents").isNotNull(), F.lit("blocked"))
        .when(F.col("_held"), F.lit("held_back"))
        .otherwise(F.lit("drop"))
    )
    word = F.when(F.col("kind") == "table", F.lit("DROP TABLE IF EXISTS ")).when(
        F.col("kind") == "view", F.lit("DROP VIEW IF EXISTS ")
    ).otherwise(F.lit("DROP MATERIALIZED VIEW IF EXISTS "))
    return joined.select(
        "relation_id", *_NAME, "kind",
        F.coalesce("dependents", F.lit(0)).cast("bigint").alias("dependents"),
        decision.alias("decision"),
        F.when(decision == "drop", F.concat(word, T.qualified(), F.lit(";"))).alias("statement"),
    )
