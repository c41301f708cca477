"""Role graph: who belongs to what, and which grants reach whom.

Edges are ``(member, role, inherit)``; grants are ``(scope, object_name, grantee,
privilege, grantor, grantable)`` where a NULL grantee is PUBLIC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate.functions import predicates as P
from estate.plans.closure import closure
from estate.plans.shapes import skewed_join
from estate.session import materialize

PUBLIC = "public"

# Role flags in report order, and default-privilege object codes.
ROLE_FLAGS = (
    ("superuser", "SUPERUSER"),
    ("create_db", "CREATEDB"),
    ("create_role", "CREATEROLE"),
    ("replication", "REPLICATION"),
    ("bypass_rls", "BYPASSRLS"),
)
DEFAULT_OBJECT_LABELS = {"r": "table", "S": "sequence", "f": "function", "T": "type"}
# What a group has where it has no attributes of its own.
_GROUP_DEFAULTS = {
    "can_login": False, "superuser": False, "create_db": False, "create_role": False,
    "inherit": True, "replication": False, "bypass_rls": False, "connection_limit": -1,
}


def ancestors(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Every role a member belongs to, at any depth; of the members in ``of``, if given.

    ``depth`` is the shortest, ``via`` the role just before the ancestor on a
    shortest path (smallest name on ties), ``inherit`` whether some path passes
    privileges on end to end.
    """
    return closure(edges, "member", "role", "inherit", of).select(
        F.col("node").alias("member"), F.col("reached").alias("role"), "depth",
        F.col("flag").alias("inherit"), "via",
    )


def descendants(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Every member a role has, at any depth; of the roles in ``of``, if given."""
    return closure(edges, "role", "member", "inherit", of).select(
        F.col("node").alias("role"), F.col("reached").alias("member"), "depth",
        F.col("flag").alias("inherit"), "via",
    )


def group_members(groups: DataFrame, users: DataFrame) -> DataFrame:
    """Members of groups kept as id arrays: one equi join, no array search."""
    ids = groups.select("group_name", F.explode("member_ids").alias("user_id")).distinct()
    return ids.join(users, "user_id").select("group_name", "user_id", "user_name")


def privilege_closure(
    roles: DataFrame, reached: DataFrame | None = None, public: bool = True
) -> DataFrame:
    """``(role, holder)``: whose grants each role has.

    The role itself, PUBLIC, and every ancestor reached with inherit. Without
    ``reached`` only direct grants count.
    """
    own = roles.select("role", F.col("role").alias("holder"))
    if public:
        own = own.unionByName(roles.select("role", F.lit(PUBLIC).alias("holder")))
    if reached is None:
        return own
    inherited = reached.where("inherit").select(
        F.col("member").alias("role"), F.col("role").alias("holder")
    )
    return own.unionByName(inherited)


def effective_privileges(holders: DataFrame, acl: DataFrame) -> DataFrame:
    """Grants reaching each role, with the role they come through.

    ``holders`` is a privilege closure without PUBLIC: what everybody holds is
    listed once, under the role ``public``, and not repeated for every role. A group
    that most roles belong to is split among tasks, and its grants go to each of them.
    The closure is written once, as it is counted before it is joined.
    """
    holders = materialize(holders.select("role", "holder"), "holders")
    grants = acl.withColumnRenamed("grantee", "holder")
    named = skewed_join(holders, grants.where(F.col("holder").isNotNull()), "holder")
    everyone = grants.where(F.col("holder").isNull()).select(
        *[c for c in grants.columns if c != "holder"],
        F.lit(PUBLIC).alias("holder"), F.lit(PUBLIC).alias("role"),
    )
    return named.unionByName(everyone).withColumnRenamed("holder", "via")


def schema_privilege_matrix(holders: DataFrame, schema_acl: DataFrame) -> DataFrame:
    """Role by schema with one flag each for USAGE and CREATE; empty cells are absent."""
    wanted = schema_acl.where(F.col("privilege").isin("USAGE", "CREATE")).groupBy(
        "schema_name", "grantee"
    ).agg(
        F.max(F.col("privilege") == "USAGE").alias("can_use"),
        F.max(F.col("privilege") == "CREATE").alias("can_create"),
    )
    reached = effective_privileges(holders, wanted)
    return reached.groupBy("role", "schema_name").agg(
        F.max("can_use").alias("can_use"), F.max("can_create").alias("can_create")
    )


def owned_label(kind: str = "relkind"):
    """Owned relations are counted with partitioned tables among the tables."""
    return F.when(F.col(kind) == "p", F.lit("table")).otherwise(P.kind_label(kind))


def owned_summary(relations: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Owned schemas and relation counts by schema and kind, with the owner's total."""
    counts = (
        relations.where(F.col("relkind").isin("r", "v", "m", "p", "S", "f"))
        .groupBy("target", "owner", "schema_name", owned_label().alias("kind"))
        .agg(F.count("*").alias("objects"))
    )
    totals = counts.groupBy("target", "owner").agg(F.sum("objects").alias("total_relations"))
    relation_rows = counts.join(totals, ["target", "owner"])
    schema_rows = namespaces.where(F.col("owner").isNotNull()).select(
        "target", "owner", "schema_name", F.lit("schema").alias("kind"),
        F.lit(1).cast("bigint").alias("objects"),
        F.lit(None).cast("bigint").alias("total_relations"),
    )
    return relation_rows.unionByName(schema_rows)


def effective_defaults(holders: DataFrame, default_acl: DataFrame) -> DataFrame:
    """Grants on future objects that reach each role."""
    labelled = default_acl.select(
        "owner", F.coalesce("schema_name", F.lit("")).alias("schema_name"),
        P.lookup(DEFAULT_OBJECT_LABELS, F.col("object_code"), F.col("object_code")).alias(
            "object_type"),
        "grantee", "privilege", "grantable",
    )
    return effective_privileges(holders, labelled)


def role_roster(roles: DataFrame, edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Roles with attributes and direct parent and member counts; built-ins hidden.

    Groups kept as id arrays are listed with the length of their array.
    """
    parents = edges.groupBy(F.col("member").alias("name")).agg(F.count("*").alias("_up"))
    members = edges.groupBy(F.col("role").alias("name")).agg(F.count("*").alias("_down"))
    shown = roles.where(~F.col("role").startswith("pg_")).withColumnRenamed("role", "name")
    zero = F.lit(0).cast("bigint")
    attributes = ["can_login", "superuser", "create_db", "create_role"]
    listed = shown.join(parents, "name", "left").join(members, "name", "left").select(
        "name", *attributes,
        F.coalesce("_up", zero).alias("parents"), F.coalesce("_down", zero).alias("members"),
    )
    if groups is None:
        return listed
    return listed.unionByName(groups.select(
        F.col("group_name").alias("name"),
        *[F.lit(False).alias(a) for a in attributes], zero.alias("parents"),
        F.coalesce(F.when(F.col("member_ids").isNotNull(), F.size("member_ids")), F.lit(0))
        .cast("bigint").alias("members"),
    ))


def role_attributes(roles: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """Attributes with flag text; ``password_set`` is NULL when no store was readable.

    Groups (``is_group``) have no attributes: missing ones take the defaults of a
    group, and a group never has a password.
    """
    filled = {
        c: F.coalesce(F.col(c), F.when(F.col("is_group"), F.lit(v)))
        for c, v in _GROUP_DEFAULTS.items()
    }
    out = roles.withColumns(filled)
    if secrets is None:
        known = F.lit(None).cast("boolean")
    else:
        stored = secrets.select("role", F.col("verifier").isNotNull().alias("_stored"))
        out = out.join(stored, "role", "left")
        known = F.coalesce("_stored", F.lit(False))
    flags = [F.when(F.col(c), F.lit(word)) for c, word in ROLE_FLAGS]
    flags.append(F.when(~F.col("inherit"), F.lit("NOINHERIT")))
    return out.withColumns({
        "password_set": F.when(F.col("is_group"), F.lit(False)).otherwise(known),
        "flags": F.concat_ws(" · ", *flags),
    }).drop("_stored")


def describe_roles(
    roles: DataFrame,
    edges: DataFrame,
    acl: DataFrame,
    relations: DataFrame,
    namespaces: DataFrame,
    direct_only: bool = False,
    only: DataFrame | None = None,
) -> DataFrame:
    """The whole report for all roles, one row per ``(role, section, item)``.

    With ``only``, a frame of role names, the report and the walks of the role graph
    are for those alone. Nothing is collected into per-role lists, as a role may hold
    any number of grants.
    """
    up = down = materialize(ancestors(edges, only), "ancestors")
    if only is not None:
        down = descendants(edges, only).select("member", "role", "depth", "inherit", "via")
        one = only.select(F.col(only.columns[0]).alias("role")).distinct()
        roles = roles.join(one, "role", "left_semi")
    held = effective_privileges(
        privilege_closure(roles, None if direct_only else up, public=False), acl
    )
    owned = owned_summary(relations, namespaces)
    if only is not None:
        owned = owned.join(one.withColumnRenamed("role", "owner"), "owner", "left_semi")

    def section(df: DataFrame, label: str, role: str, item, detail) -> DataFrame:
        return df.select(
            F.col(role).alias("role"), F.lit(label).alias("section"),
            item.alias("item"), detail.alias("detail"),
        )

    passes = F.when(F.col("inherit"), F.lit("inherit")).otherwise(F.lit("no inherit"))
    chain = F.concat_ws(" ", F.lit("depth"), F.col("depth").cast("string"), F.lit("via"), "via", passes)
    parts = [
        section(roles, "login", "role", F.lit("can_login"), F.col("can_login").cast("string")),
        section(up, "member_of", "member", F.col("role"), chain),
        section(down, "members", "role", F.col("member"),
                F.concat_ws(" ", F.lit("depth"), F.col("depth").cast("string"), passes)),
        section(held, "privileges", "role", F.concat_ws(":", "scope", "object_name"),
                F.concat_ws(" ", "privilege", F.lit("via"), "via")),
        section(owned, "owns", "owner", F.concat_ws(".", "target", "schema_name"),
                F.concat_ws(" ", F.col("objects").cast("string"), "kind")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
