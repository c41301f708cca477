"""Schema roster, quotas, and plans over schema privileges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.functions import predicates as P
from estate.functions import text as T
from estate.functions.quota import parse_quota
from estate.plans.shapes import hot_join

# Privileges in the order plans emit them, and what a preset means.
PRIVILEGE_ORDER = (
    "usage", "create", "all",
    "select", "insert", "update", "delete", "table-all",
    "sequence-usage", "function-execute",
    "default-select", "default-all",
)
SCHEMA_LEVEL = ("usage", "create", "all")
TABLE_LEVEL = ("select", "insert", "update", "delete", "table-all")
DEFAULT_LEVEL = ("default-select", "default-all")
PRESETS = {
    "read": ("usage", "select", "default-select"),
    "readwrite": ("usage", "create", "table-all", "default-all"),
}
_NEEDS_USAGE = tuple(p for p in PRIVILEGE_ORDER if p not in SCHEMA_LEVEL)
PUBLIC = "PUBLIC"


def schema_roster(
    namespaces: DataFrame,
    relations: DataFrame,
    like: str | None = None,
    include_system: bool = False,
) -> DataFrame:
    """Schemas with owner (``?`` when unknown) and object counts, zeros when empty."""
    wanted = namespaces
    if not include_system:
        wanted = P.hide_system(wanted)
        relations = P.hide_system(relations)
    if like is not None:
        wanted = wanted.where(P.glob("schema_name", like))
        relations = relations.where(P.glob("schema_name", like))
    kind = F.col("relkind")
    counts = relations.groupBy("target", "schema_name").agg(
        F.count_if(kind.isin("r", "p", "f")).alias("tables"),
        F.count_if(kind.isin("v", "m")).alias("views"),
        F.count_if(kind.isin("S", "c")).alias("other"),
    )
    zero = F.lit(0).cast("bigint")
    return wanted.join(counts, ["target", "schema_name"], "left").select(
        "target", "schema_name", F.coalesce("owner", F.lit("?")).alias("owner"),
        *[F.coalesce(c, zero).alias(c) for c in ("tables", "views", "other")],
    )


def schema_quota(roster: DataFrame, quotas: DataFrame) -> DataFrame:
    """Quota, use and share per schema; what is unknown stays NULL.

    ``quotas`` is ``(target, schema_name, quota, used_mb)`` with the quota as text.
    """
    parsed = quotas.withColumn("_q", parse_quota("quota")).select(
        "target", "schema_name", F.col("_q.text").alias("quota"), F.col("_q.mb").alias("quota_mb"),
        F.col("_q.valid").alias("quota_valid"), "used_mb",
    )
    share = F.when(F.col("quota_mb") > 0, F.col("used_mb") / F.col("quota_mb"))
    return roster.join(parsed, ["target", "schema_name"], "left").withColumn("used_share", share)


def _named_by(privilege: str) -> tuple[str, ...]:
    """Tokens that ask for a privilege: itself and the presets that hold it."""
    return (privilege, *[preset for preset, held in PRESETS.items() if privilege in held])


def _asks_for(tokens: str, privilege: str) -> Column:
    """Whether the tokens name the privilege; usage is implied by every object privilege."""
    names = _named_by(privilege)
    if privilege == "usage":
        names = (*names, *_NEEDS_USAGE)
    return F.arrays_overlap(F.col(tokens), F.array(*map(F.lit, names)))


def _tokenised(requests: DataFrame, tokens: str) -> DataFrame:
    return requests.withColumn("_tokens", F.split(F.lower(F.trim(tokens)), r"\s*,\s*"))


def _unknown() -> Column:
    known = F.array(*map(F.lit, (*PRIVILEGE_ORDER, *PRESETS, "")))
    return F.array_except("_tokens", known)


def expand_privileges(requests: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Presets expanded, usage implied, repeats dropped, canonical order, unknowns apart.

    ``tokens`` is a comma list. Works row by row on built-in array functions that
    compile into the stage: no join, no shuffle, no interpreted lambda.
    """
    marked = F.array(*[F.when(_asks_for("_tokens", p), F.lit(p)) for p in PRIVILEGE_ORDER])
    named = F.array_except(marked, F.array(F.lit(None).cast("string")))
    status = F.when(F.size("unknown") > 0, F.lit("unknown_privilege")).when(
        F.size("privileges") == 0, F.lit("no_privilege")
    )
    return (
        _tokenised(requests, tokens)
        .withColumns({"privileges": named, "unknown": _unknown()})
        .withColumn("status", status.otherwise(F.lit("ok")))
        .drop("_tokens")
    )


def merge_requests(requests: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row per grantee with the union of everything asked for it.

    Only the fixed vocabulary is carried through the aggregation, one flag per
    privilege, so a grantee named millions of times stays one small row.
    """
    flags = [F.max(_asks_for("_tokens", p)).alias(f"_{i}") for i, p in enumerate(PRIVILEGE_ORDER)]
    named = F.array_compact(F.array(*[
        F.when(F.col(f"_{i}"), F.lit(p)) for i, p in enumerate(PRIVILEGE_ORDER)
    ]))
    return _tokenised(requests, tokens).groupBy("grantee").agg(
        F.count("*").alias("requests"), F.count_if(F.size(_unknown()) > 0).alias("bad_requests"), *flags
    ).select("grantee", "requests", "bad_requests", named.alias("privileges"))


def held_schema_privileges(acl: DataFrame, grantees: DataFrame) -> DataFrame:
    """Schema privileges in force for the grantees, matched on name and kind.

    The kind matters: a user and a group may share a name. PUBLIC is matched by
    its keyword; only USAGE and CREATE count.
    """
    named = acl.where(F.col("privilege").isin("USAGE", "CREATE")).select(
        "schema_name", F.coalesce("grantee", F.lit(PUBLIC)).alias("grantee"),
        F.when(F.col("grantee").isNull(), F.lit("public")).otherwise(F.col("grantee_kind")).alias("kind"),
        F.lower("privilege").alias("privilege"),
    )
    public = F.upper("name") == PUBLIC
    wanted = grantees.select(
        F.when(public, F.lit(PUBLIC)).otherwise(F.col("name")).alias("grantee"),
        F.when(public, F.lit("public")).otherwise(F.col("kind")).alias("kind"),
    )
    return named.join(wanted, ["grantee", "kind"], "left_semi").select(
        "schema_name", "grantee", "privilege"
    ).distinct()


def _spelled(engine: Column) -> Column:
    quoted = T.quote("grantee")
    redshift = engine == "redshift"
    return (
        F.when(F.upper("grantee") == PUBLIC, F.lit(PUBLIC))
        .when(redshift & (F.col("kind") == "group"), F.concat(F.lit("GROUP "), quoted))
        .when(redshift & (F.col("kind") == "role"), F.concat(F.lit("ROLE "), quoted))
        .otherwise(quoted)
    )


def _statement(revoke: bool, cascade: bool) -> Column:
    verb, to = ("REVOKE ", " FROM ") if revoke else ("GRANT ", " TO ")
    tail = F.concat(F.lit(to), _spelled(F.col("engine")),
                    F.lit(" CASCADE;" if revoke and cascade else ";"))
    schema = T.quote("schema_name")
    name = F.col("privilege")
    word = F.when(name.isin("table-all", "all", "default-all"), F.lit("ALL")).otherwise(F.upper(name))
    owner_word = F.when(F.col("engine") == "redshift", F.lit("USER ")).otherwise(F.lit("ROLE "))
    on = lambda text: F.concat(F.lit(text), schema)
    plain = (
        F.when(name.isin(*SCHEMA_LEVEL), F.concat(word, on(" ON SCHEMA ")))
        .when(name.isin(*TABLE_LEVEL), F.concat(word, on(" ON ALL TABLES IN SCHEMA ")))
        .when(name == "sequence-usage", F.concat(F.lit("USAGE"), on(" ON ALL SEQUENCES IN SCHEMA ")))
        .when(name == "function-execute", F.concat(F.lit("EXECUTE"), on(" ON ALL FUNCTIONS IN SCHEMA ")))
    )
    future = F.concat(
        F.lit("ALTER DEFAULT PRIVILEGES FOR "), owner_word, T.quote("grantor"), on(" IN SCHEMA "),
        F.lit(" " + verb), F.when(name == "default-all", F.lit("ALL")).otherwise(F.lit("SELECT")),
        F.lit(" ON TABLES"),
    )
    return F.concat(F.when(name.isin(*DEFAULT_LEVEL), future).otherwise(
        F.concat(F.lit(verb), plain)), tail)


def schema_grant_plan(
    requests: DataFrame,
    held: DataFrame,
    owners: DataFrame,
    default_for: str | None = None,
    revoke: bool = False,
    cascade: bool = False,
) -> DataFrame:
    """One row per schema, grantee and privilege asked for, in canonical order.

    ``requests`` is ``(request_id, engine, schemas, grantee, kind, privileges)``.
    ``action`` is grant or revoke, already_held (schema-level privileges in force,
    never when revoking), skip:unsupported, error:grantee_not_found or
    error:no_grantor. Future-object privileges need a grantor: ``default_for``,
    else the owner of the schema.
    """
    # The outer form, as the plain one adds a filter that works the arrays out twice.
    asked = requests.select(
        "request_id", "engine", "grantee", "kind", "privileges",
        F.explode(F.array_distinct("schemas")).alias("schema_name"),
    ).select("request_id", "engine", "grantee", "kind", "schema_name",
             F.explode_outer("privileges").alias("privilege")).where(F.col("privilege").isNotNull())
    grantors = owners.select("schema_name", F.col("owner").alias("grantor"))
    plan = hot_join(asked, grantors, ["schema_name"], "left", by=["request_id", "privilege"])
    if default_for:
        plan = plan.withColumn("grantor", F.lit(default_for))
    name = F.col("privilege")
    future = name.isin(*DEFAULT_LEVEL)
    redshift = F.col("engine") == "redshift"
    not_public = F.upper("grantee") != PUBLIC
    unsupported = redshift & (
        (name == "sequence-usage") | (future & (F.col("kind") == "role") & not_public)
    )
    action = F.when(F.col("kind").isNull() & not_public, F.lit("error:grantee_not_found"))
    if not revoke:
        mark = held.select("schema_name", "grantee", "privilege", F.lit(True).alias("_held"))
        plan = plan.join(mark, ["schema_name", "grantee", "privilege"], "left")
        action = action.when(F.col("_held") & name.isin(*SCHEMA_LEVEL), F.lit("already_held"))
    action = (
        action.when(F.coalesce(unsupported, F.lit(False)), F.lit("skip:unsupported"))
        .when(future & F.col("grantor").isNull(), F.lit("error:no_grantor"))
        .otherwise(F.lit("revoke" if revoke else "grant"))
    )
    position = F.array_position(F.array(*map(F.lit, PRIVILEGE_ORDER)), name)
    return plan.withColumn("action", action).select(
        "request_id", "schema_name", "grantee", "kind", "privilege",
        position.cast("int").alias("position"), "action",
        F.when(F.col("action").isin("grant", "revoke"), _statement(revoke, cascade)).alias("statement"),
    )


def schema_drop_impact(
    roster: DataFrame,
    names: DataFrame | None = None,
    like: str | None = None,
    cascade: bool = False,
) -> DataFrame:
    """What dropping schemas would destroy.

    ``names`` is ``(target, schema_name)``; a glob never picks protected schemas,
    a named one is refused. ``status`` is ok, protected, missing or blocked (not
    empty and no cascade).
    """
    if (names is None) == (like is None):
        raise ValueError("give names or a pattern")
    if names is None:
        picked = roster.where(P.glob("schema_name", like) & ~P.is_protected())
    else:
        picked = names.select("target", "schema_name").distinct().join(
            roster, ["target", "schema_name"], "left"
        )
    objects = F.col("tables") + F.col("views") + F.col("other")
    status = (
        F.when(P.is_protected(), F.lit("protected"))
        .when(F.col("tables").isNull(), F.lit("missing"))
        .when((objects > 0) & F.lit(not cascade), F.lit("blocked"))
        .otherwise(F.lit("ok"))
    )
    drop = F.concat(F.lit("DROP SCHEMA "), T.quote("schema_name"),
                    F.lit(" CASCADE;" if cascade else " RESTRICT;"))
    return picked.select(
        "target", "schema_name", status.alias("status"), objects.alias("objects"),
        F.when(status == "ok", drop).alias("statement"),
    )


def grantees_of(requests: DataFrame, names: Sequence[str] = ("grantee", "kind")) -> DataFrame:
    """The distinct grantees of a plan, ready for the held check."""
    return requests.select(F.col(names[0]).alias("name"), F.col(names[1]).alias("kind")).distinct()
