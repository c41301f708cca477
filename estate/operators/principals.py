"""Names to principals, and plans over memberships and ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate.functions import text as T
from estate.plans.shapes import hot_join, split_members
from estate.session import materialize

KINDS = ("user", "group", "role")


def resolve_kinds(
    names: DataFrame,
    principals: DataFrame,
    forced: str | None = None,
    allow_public: bool = False,
) -> DataFrame:
    """One kind per distinct name, or why there is none.

    ``status`` is ok, absent, ambiguous (several kinds), not_that_kind (a forced
    kind the name does not have) or public_not_allowed. Guessing between kinds
    would grant something nobody asked for, so it is never done.
    """
    wanted = names.select("name").distinct()
    kinds = principals.groupBy("name").agg(
        *[F.max(F.col("kind") == k).alias(f"_{k}") for k in KINDS]
    )
    is_public = F.upper("name") == "PUBLIC"
    found = F.array_compact(F.array(*[F.when(F.col(f"_{k}"), F.lit(k)) for k in KINDS]))
    listed = wanted.join(kinds, "name", "left").withColumn("_found", found)
    count = F.size("_found")
    status = F.when(is_public, F.lit("ok" if allow_public else "public_not_allowed")).when(
        count == 0, F.lit("absent")
    )
    if forced is None:
        status = status.when(count > 1, F.lit("ambiguous")).otherwise(F.lit("ok"))
        kind = F.when(count == 1, F.get("_found", F.lit(0)))
    else:
        has = F.array_contains("_found", forced)
        status = status.when(~has, F.lit("not_that_kind")).otherwise(F.lit("ok"))
        kind = F.when(has, F.lit(forced))
    kind = F.when(is_public, F.lit("role" if allow_public else None)).otherwise(kind)
    return listed.select(
        "name", kind.alias("kind"), F.concat_ws(", ", "_found").alias("found"),
        status.alias("status"),
    )


def held_grants(
    role_to_user: DataFrame, role_to_role: DataFrame, group_to_user: DataFrame
) -> DataFrame:
    """``(role, grantee)`` pairs in force, whichever catalog records them.

    Role-to-role rows are kept as ``(member, role)`` and turned round here.
    """
    pairs = (
        role_to_user.select("role", F.col("user_name").alias("grantee"))
        .unionByName(role_to_role.select("role", F.col("member").alias("grantee")))
        .unionByName(group_to_user.select(
            F.col("group_name").alias("role"), F.col("user_name").alias("grantee")))
    )
    return pairs.distinct()


def _kind_rules(role_kind: Column, target_kind: Column, users_hold: Column) -> Column:
    return (
        F.when((role_kind == "user") & ~users_hold, F.lit("a login user holds no members here"))
        .when((role_kind == "group") & (target_kind == "role"), F.lit("a group holds users only"))
        .when((role_kind == "role") & (target_kind == "group"), F.lit("a group takes no roles"))
    )


def grant_plan(
    requests: DataFrame,
    principals: DataFrame,
    held: DataFrame,
    create_missing_users: bool = False,
) -> DataFrame:
    """What granting would do, one row per requested (role, grantee) pair.

    A request holds its lists, ``(request_id, engine, roles, grantees)``; the
    pairs are what the request asks for. ``action`` is grant, already_held,
    create_user_and_grant, error or invalid, with a reason for the last two.
    """
    # Names meet their kinds while a request is one row per name, and its pairs are made
    # after that, so that no join by name moves them.
    roles, grantees = F.array_distinct("roles"), F.array_distinct("grantees")
    named = requests.withColumn("_row", F.monotonically_increasing_id()).select(
        "request_id", "engine", "_row", F.size(roles).alias("_roles"),
        F.posexplode(F.concat(roles, grantees)).alias("_pos", "name"),
    )
    kinds = principals.groupBy("name").agg(F.min("kind").alias("_kind"))
    named = hot_join(named, kinds, ["name"], "left", by=["_row", "_pos"])
    is_role = F.col("_pos") < F.col("_roles")
    role = F.when(is_role, F.struct(F.col("name").alias("role"), F.col("_kind").alias("role_kind")))
    pairs = (
        named.withColumn("_of", F.collect_list(role).over(Window.partitionBy("_row"))).where(~is_role)
        .select("request_id", "engine", F.explode("_of").alias("_r"), F.col("name").alias("grantee"),
                F.col("_kind").alias("grantee_kind"))
        .select("request_id", "engine", "_r.*", "grantee", "grantee_kind")
    )
    # Only pairs that may be in force are dealt out for the join that tells it.
    pair = F.xxhash64("role", "grantee").alias("_pair")
    in_force = materialize(held.select("role", "grantee"), "in-force")
    some, none = split_members(pairs.withColumn("_pair", pair), "_pair", in_force.select(pair))
    marked = some.join(in_force.withColumn("_held", F.lit(True)), ["role", "grantee"], "left")
    joined = marked.unionByName(none.withColumn("_held", F.lit(None).cast("boolean")))
    absent = F.col("grantee_kind").isNull()
    target_kind = F.when(absent, F.lit("user")).otherwise(F.col("grantee_kind"))
    refused = _kind_rules(F.col("role_kind"), target_kind, F.col("engine") != "redshift")
    missing = F.when(F.col("role_kind").isNull(), F.lit("role not found"))
    if not create_missing_users:
        missing = missing.when(absent, F.lit("grantee not found"))
    reason = F.coalesce(missing, refused)
    action = (
        F.when(missing.isNotNull(), F.lit("error"))
        .when(refused.isNotNull(), F.lit("invalid"))
        .when(F.col("_held"), F.lit("already_held"))
        .when(absent, F.lit("create_user_and_grant"))
        .otherwise(F.lit("grant"))
    )
    return joined.select(
        "request_id", "role", "role_kind", "grantee", target_kind.alias("grantee_kind"),
        action.alias("action"), reason.alias("reason"),
    )


def handover_plan(
    leavers: DataFrame,
    namespaces: DataFrame,
    relations: DataFrame,
    memberships: DataFrame,
    defaults: DataFrame,
    explicit: str | None = None,
    reassign: bool = True,
) -> DataFrame:
    """What has to change hands before principals are dropped.

    Phases: 1 owned schemas, 2 owned tables and views, 3 memberships, 4 the drop.
    The new owner is ``explicit``, else the target's default, else an error row.
    ``leavers`` and ``defaults`` are ``(target, name)`` and ``(target, new_owner)``.
    """
    named = leavers.select("target", F.col("name").alias("owner"))
    ops = []
    if reassign:
        schemas = namespaces.join(named, ["target", "owner"]).select(
            "target", "owner", F.lit(1).alias("phase"),
            F.concat(F.lit("SCHEMA "), T.quote("schema_name")).alias("_object"))
        word = F.when(F.col("relkind") == "v", F.lit("VIEW ")).otherwise(F.lit("TABLE "))
        owned = relations.where(F.col("relkind").isin("r", "v")).join(named, ["target", "owner"])
        tables = owned.select("target", "owner", F.lit(2).alias("phase"),
                              F.concat(word, T.qualified()).alias("_object"))
        moved = schemas.unionByName(tables)
        owners = defaults.select("target", "new_owner")
        moved = hot_join(moved, owners, ["target"], "left", by=["owner", "_object"])
        new_owner = F.lit(explicit) if explicit else F.col("new_owner")
        ops.append(moved.select(
            "target", F.col("owner").alias("name"), "phase",
            F.when(new_owner.isNull(), F.lit("error")).otherwise(F.lit("reassign")).alias("action"),
            F.when(new_owner.isNull(), F.concat(F.lit("no new owner for "), F.col("_object")))
            .otherwise(F.concat(F.lit("ALTER "), F.col("_object"), F.lit(" OWNER TO "),
                                T.quote(new_owner), F.lit(";"))).alias("statement")))
    out = memberships.join(named, ["target", "owner"]).select(
        "target", F.col("owner").alias("name"), F.lit(3).alias("phase"),
        F.lit("leave").alias("action"),
        F.concat(F.lit("ALTER GROUP "), T.quote("group_name"), F.lit(" DROP USER "),
                 T.quote("owner"), F.lit(";")).alias("statement"))
    ops.append(out)
    ops.append(named.select(
        "target", F.col("owner").alias("name"), F.lit(4).alias("phase"), F.lit("drop").alias("action"),
        F.concat(F.lit("DROP USER "), T.quote("owner"), F.lit(";")).alias("statement")))
    plan = ops[0]
    for op in ops[1:]:
        plan = plan.unionByName(op)
    return plan
