"""Catalog description for all relations and schemas of a snapshot at once.

One DataFrame per section, keyed by relation id or ``(target, schema_name)``.
Arrays only ever hold what the catalog bounds: the columns of one constraint or
index, the roles of one policy, the privileges of one grant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.functions import predicates as P
from estate.functions import text as T
from estate.plans.closure import closure
from estate.plans.shapes import hot_join

# Catalog codes and their meaning.
IDENTITY = {"a": "GENERATED ALWAYS AS IDENTITY", "d": "GENERATED BY DEFAULT AS IDENTITY"}
IDENTITY_SHORT = {
    "GENERATED ALWAYS AS IDENTITY": "identity (always)",
    "GENERATED BY DEFAULT AS IDENTITY": "identity (default)",
}
FK_ACTIONS = {
    "a": "NO ACTION", "r": "RESTRICT", "c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT",
}
CONSTRAINT_KINDS = {"p": "primary key", "u": "unique", "f": "foreign key", "c": "check"}
CONSTRAINT_ORDER = {"p": 0, "u": 1, "f": 2}
PARTITION_STRATEGIES = {"r": "RANGE", "l": "LIST", "h": "HASH"}
TRIGGER_EVENTS = ((4, "INSERT"), (8, "DELETE"), (16, "UPDATE"), (32, "TRUNCATE"))
POLICY_COMMANDS = {"r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE"}
DEFAULT_OBJECTS = {"r": "TABLE", "S": "SEQUENCE", "f": "FUNCTION", "T": "TYPE", "n": "SCHEMA"}
DESCRIBED_KINDS = {"r": "table", "p": "table", "v": "view", "m": "matview"}


def _ordered(order: str, value: str) -> Column:
    """Values of a small group in the order of their position."""
    pairs = F.array_sort(F.collect_list(F.struct(order, value)))
    return F.transform(pairs, lambda p: p[value])


def resolve_targets(tokens: DataFrame, relations: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Kind and id for ``schema`` or ``schema.object`` tokens, one row per token.

    ``status`` is ok, not_found, bad_token or unsupported_kind; one bad token does
    not stop the others.
    """
    parts = F.split(F.trim("token"), r"\.")
    wanted = tokens.select("target", "token").distinct().withColumns({
        "schema_name": parts[0],
        "relation_name": F.get(parts, F.lit(1)),
        "_size": F.size(parts),
    })
    blank = (F.col("schema_name") == "") & (F.col("_size") == 1)
    half = (F.col("_size") == 2) & ((F.col("schema_name") == "") | (F.col("relation_name") == ""))
    wanted = wanted.withColumn("_bad", blank | half | (F.col("_size") > 2))
    schemas = namespaces.select("target", "schema_name", F.lit(True).alias("_schema"))
    found = relations.select("target", "schema_name", "relation_name", "relation_id", "relkind")
    named = wanted.join(found, ["target", "schema_name", "relation_name"], "left")
    named = hot_join(named, schemas, ["target", "schema_name"], "left", by=["token"])
    is_schema = F.col("_size") == 1
    kind = F.when(is_schema, F.when(F.col("_schema"), F.lit("schema"))).otherwise(
        P.lookup(DESCRIBED_KINDS, F.col("relkind"))
    )
    known = F.when(is_schema, F.col("_schema")).otherwise(F.col("relkind").isNotNull())
    status = (
        F.when(F.col("_bad"), F.lit("bad_token"))
        .when(~F.coalesce(known, F.lit(False)), F.lit("not_found"))
        .when(kind.isNull(), F.lit("unsupported_kind"))
        .otherwise(F.lit("ok"))
    )
    return named.select(
        "target", "token", status.alias("status"),
        F.when(~F.col("_bad"), kind).alias("kind"),
        F.when(~F.col("_bad"), F.col("relation_id")).alias("relation_id"),
    )


def constraint_report(constraint_columns: DataFrame) -> DataFrame:
    """One row per constraint from one row per constraint column.

    NOT NULL constraints are left out; a missing foreign-key action is NO ACTION.
    ``position`` sorts primary key, unique, foreign key, then the rest.
    """
    is_fk = F.col("contype") == "f"
    action = lambda c: F.when(
        is_fk, F.coalesce(P.lookup(FK_ACTIONS, F.col(c)), F.lit("NO ACTION"))
    )
    position = F.coalesce(
        *[F.when(F.col("contype") == k, F.lit(v)) for k, v in CONSTRAINT_ORDER.items()], F.lit(3)
    )
    return (
        constraint_columns.where(F.col("contype") != "n")
        .groupBy("relation_id", "con_name", "contype")
        .agg(
            _ordered("pos", "column_name").alias("columns"),
            F.min("ref_table").alias("ref_table"),
            _ordered("pos", "ref_column").alias("ref_columns"),
            F.min("del_code").alias("_del"),
            F.min("upd_code").alias("_upd"),
        )
        .select(
            "relation_id", "con_name", "contype",
            P.lookup(CONSTRAINT_KINDS, F.col("contype"), F.lit("other")).alias("kind"),
            "columns",
            F.when(is_fk, F.col("ref_table")).alias("ref_table"),
            F.when(is_fk, F.col("ref_columns")).alias("ref_columns"),
            action("_del").alias("on_delete"), action("_upd").alias("on_update"),
            position.alias("position"),
        )
    )


def fk_pairs(constraints: DataFrame) -> DataFrame:
    """The i-th local column next to the i-th referenced column."""
    pairs = F.arrays_zip(F.col("columns").alias("l"), F.col("ref_columns").alias("r"))
    return (
        constraints.where(F.col("contype") == "f")
        .select("relation_id", "con_name", "ref_table", F.posexplode(pairs).alias("_i", "_pair"))
        .select("relation_id", "con_name", (F.col("_i") + 1).alias("position"),
                F.col("_pair.l").alias("column_name"), "ref_table",
                F.col("_pair.r").alias("ref_column"))
    )


def column_report(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Columns with type, default, key membership and at most one foreign key.

    An identity clause wins over a default expression. Of several foreign keys the
    one with the smallest name is shown.
    """
    pairs = F.arrays_zip(
        F.col("columns").alias("l"), F.coalesce("ref_columns", F.array().cast("array<string>")).alias("r")
    )
    foreign = F.struct("con_name", "ref_table", F.col("_pair.r").alias("ref_column"))
    marks = (
        constraints.where(F.col("contype").isin("p", "f"))
        .select("relation_id", "con_name", "contype", "ref_table", F.explode(pairs).alias("_pair"))
        .groupBy("relation_id", F.col("_pair.l").alias("column_name"))
        .agg(F.max(F.col("contype") == "p").alias("_pk"), F.min(F.when(F.col("contype") == "f", foreign)).alias("_fk"))
    )
    default = F.coalesce(P.lookup(IDENTITY, F.col("identity_code")), F.col("default_expr"))
    return (
        columns.join(marks, ["relation_id", "column_name"], "left")
        .withColumn("default_expr", default)
        .select(
            "relation_id", "ordinal", "column_name", "data_type",
            (~F.col("not_null")).alias("nullable"), "default_expr",
            P.lookup(IDENTITY_SHORT, F.col("default_expr"), F.col("default_expr")).alias("default_short"),
            F.coalesce("_pk", F.lit(False)).alias("is_pk"),
            F.col("_fk.ref_table").alias("fk_table"), F.col("_fk.ref_column").alias("fk_column"),
            "comment",
        )
    )


def index_report(index_columns: DataFrame) -> DataFrame:
    """Indexes with their columns in key order; ``position`` sorts PK, unique, name."""
    about = ["is_primary", "is_unique", "method", "size_bytes", "predicate"]
    rank = F.when(F.col("is_primary"), F.lit(0)).when(F.col("is_unique"), F.lit(1)).otherwise(F.lit(2))
    return (
        index_columns.groupBy("relation_id", "index_name")
        .agg(_ordered("pos", "column_name").alias("columns"),
             *[F.max(c).alias(c) for c in about])
        .select("relation_id", "index_name", "columns", *about, rank.alias("position"))
    )


def tree_rollup(relations: DataFrame, inherits: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Sizes of every relation summed over itself and all partitions below it.

    ``of`` names the relations to report on; only their trees are walked.

    Rows are summed over leaves only, as a partitioned parent already counts its
    children; without any known leaf the relation's own estimate is used.
    """
    own = relations.select(F.col("relation_id").alias("root"), F.col("relation_id").alias("member"))
    roots = relations
    if of is not None:
        of = of.select(F.col(of.columns[0]).alias("relation_id")).distinct()
        roots = relations.join(of, "relation_id", "left_semi")
        own = roots.select(F.col("relation_id").alias("root"), F.col("relation_id").alias("member"))
    below = closure(inherits, "parent_id", "child_id", starts=of).select(
        F.col("node").alias("root"), F.col("reached").alias("member")
    )
    figures = relations.select(
        F.col("relation_id").alias("member"), "total_size", "table_size", "index_size",
        F.when((F.col("relkind") != "p") & (F.col("row_estimate") >= 0), F.col("row_estimate"))
        .alias("_leaf_rows"),
    )
    known_rows = F.when(F.col("row_estimate") >= 0, F.col("row_estimate"))
    sums = (
        own.unionByName(below)
        .join(figures, "member")
        .groupBy(F.col("root").alias("relation_id"))
        .agg(
            F.sum("_leaf_rows").alias("_rows"),
            F.sum("total_size").alias("total_size"),
            F.sum("table_size").alias("table_size"),
            F.sum("index_size").alias("index_size"),
            F.sum(F.col("total_size") - F.col("table_size") - F.col("index_size")).alias("toast_size"),
            (F.count("*") - 1).alias("descendants"),
        )
    )
    return roots.select("relation_id", known_rows.alias("_own")).join(sums, "relation_id").select(
        "relation_id", "descendants", F.coalesce("_rows", "_own").alias("row_estimate"),
        "total_size", "table_size", "index_size", "toast_size",
    )


def clean_bounds(col: Column | str) -> Column:
    """List bounds without their clause; ranges and DEFAULT as they are."""
    raw = F.trim(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))
    inner = F.regexp_extract(raw, r"(?s)^FOR VALUES IN \((.*)\)$", 1)
    is_list = raw.startswith("FOR VALUES IN (") & raw.endswith(")")
    return F.when(is_list, F.trim(inner)).otherwise(raw)


def key_columns(key: Column) -> Column:
    """Columns of a partition key definition such as ``RANGE (a, b)``."""
    inner = F.regexp_extract(key, r"(?is)^(?:LIST|RANGE|HASH) \((.*)$", 1)
    return F.when(key.rlike(r"(?i)^(LIST|RANGE|HASH) \("),
                  F.trim(F.regexp_replace(inner, r"\)$", ""))).otherwise(F.coalesce(key, F.lit("")))


def partition_report(inherits: DataFrame, relations: DataFrame) -> DataFrame:
    """Partitions with their parent, strategy, key and cleaned bounds.

    ``inherits`` is ``(child_id, parent_id, bounds)``; only partitioned parents
    (kind p) count, and those carry ``strategy_code`` and ``partition_key``.
    """
    parents = relations.where(F.col("relkind") == "p").select(
        F.col("relation_id").alias("parent_id"),
        T.qualified().alias("parent"),
        P.lookup(PARTITION_STRATEGIES, F.col("strategy_code")).alias("strategy"),
        key_columns(F.col("partition_key")).alias("key_columns"),
    )
    children = relations.select(F.col("relation_id").alias("child_id"), T.qualified().alias("child"))
    parts = hot_join(inherits, parents, ["parent_id"], by=["child_id"])
    return parts.join(children, "child_id").select(
        "child_id", "child", "parent_id", "parent", "strategy", "key_columns",
        clean_bounds("bounds").alias("bounds"),
    )


def relation_grants(acl: DataFrame, relations: DataFrame) -> DataFrame:
    """Grants on relations and a synthetic OWNER row for each."""
    columns = ["relation_id", "grantee", "privilege", "grantable", "grantor"]
    owners = relations.select(
        "relation_id", F.col("owner").alias("grantee"), F.lit("OWNER").alias("privilege"),
        F.lit(False).alias("grantable"), F.lit("").alias("grantor"),
    )
    return acl.select(*columns).unionByName(owners)


def trigger_report(triggers: DataFrame) -> DataFrame:
    """Timing and events of triggers from their type bits."""
    bit = lambda mask: F.col("tgtype").bitwiseAND(mask) != 0
    timing = F.when(bit(2), F.lit("BEFORE")).when(bit(64), F.lit("INSTEAD OF")).otherwise(F.lit("AFTER"))
    events = F.concat_ws(" OR ", *[F.when(bit(m), F.lit(w)) for m, w in TRIGGER_EVENTS])
    return triggers.withColumns({"timing": timing, "events": events})


def policy_report(policies: DataFrame, roles: DataFrame) -> DataFrame:
    """Row policies with the command spelled out and role names, ``public`` if none."""
    exploded = policies.select(
        "relation_id", "policy_name", "command_code", F.explode_outer("role_ids").alias("role_id")
    )
    # Policies without roles have no name to look for, and would all meet on the null key.
    given = exploded.where(F.col("role_id").isNotNull())
    named = hot_join(given, roles.select("role_id", "role"), ["role_id"], "left",
                     by=["relation_id", "policy_name"])
    bare = exploded.where(F.col("role_id").isNull()).withColumn("role", F.lit(None).cast(roles.schema["role"].dataType))
    named = named.unionByName(bare)
    names = F.array_sort(F.collect_set("role"))
    return (
        named.groupBy("relation_id", "policy_name", "command_code")
        .agg(names.alias("_roles"))
        .select(
            "relation_id", "policy_name",
            P.lookup(POLICY_COMMANDS, F.col("command_code"), F.lit("ALL")).alias("command"),
            F.when(F.size("_roles") == 0, F.array(F.lit("public"))).otherwise(F.col("_roles")).alias("roles"),
        )
    )


def view_dependencies(edges: DataFrame, relations: DataFrame, direction: str) -> DataFrame:
    """Distinct direct dependencies: ``upstream`` (read by a view) or ``downstream``."""
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"direction must be upstream or downstream, got {direction!r}")
    up = direction == "upstream"
    near, far = ("view_id", "source_id") if up else ("source_id", "view_id")
    kinds = ("r", "v", "m", "f", "p") if up else ("v", "m")
    others = relations.where(F.col("relkind").isin(*kinds)).select(
        F.col("relation_id").alias(far), T.qualified().alias("name"), P.kind_label().alias("kind")
    )
    distinct = edges.where(F.col(near) != F.col(far)).select(near, far).distinct()
    return distinct.join(others, far).select(F.col(near).alias("relation_id"), "name", "kind")


def view_lineage(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Everything a view depends on, over any number of views; of the views in ``of``, if given."""
    return closure(edges, "view_id", "source_id", starts=of).select(
        F.col("node").alias("view_id"), F.col("reached").alias("source_id"), "depth"
    )


def view_report(views: DataFrame) -> DataFrame:
    """View definitions; a missing definition is reported, not dropped."""
    check = F.upper("check_option")
    return views.select(
        "relation_id", "definition",
        (F.upper("is_updatable") == "YES").alias("updatable"),
        F.when(check != "NONE", F.col("check_option")).alias("check_option"),
        F.when(F.col("definition").isNull(), F.lit("not_found")).otherwise(F.lit("ok")).alias("status"),
    )


def schema_contents(relations: DataFrame) -> DataFrame:
    """Relations of each schema with label; rows and bytes only where they mean something."""
    kind = F.col("relkind")
    rows = F.when(kind.isin("r", "m", "p") & (F.col("row_estimate") >= 0), F.col("row_estimate"))
    size = F.when(kind.isin("r", "m", "p", "i", "S"), F.col("size_bytes"))
    return relations.where(kind.isin("r", "v", "m", "p", "S", "f")).select(
        "target", "schema_name", "relation_name", P.kind_label().alias("kind"),
        rows.alias("row_estimate"), size.alias("size_bytes"),
    )


def schema_card(contents: DataFrame) -> DataFrame:
    """Counts per kind, total rows and total size of each schema."""
    per_kind = contents.groupBy("target", "schema_name", "kind").agg(
        F.count("*").alias("n"), F.sum("row_estimate").alias("_rows"), F.sum("size_bytes").alias("_size")
    )
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))
    return per_kind.groupBy("target", "schema_name").agg(
        counts.alias("counts"), F.sum("n").alias("objects"),
        F.sum("_rows").alias("total_rows"), F.sum("_size").alias("total_size"),
    )


def schema_grants(namespaces: DataFrame, reached: DataFrame) -> DataFrame:
    """Grants on schemas, with the built-in default where no ACL was ever set.

    ``namespaces.acl`` is an array of ``(grantee, privilege, grantor, grantable)``;
    NULL means the owner holds USAGE and CREATE. The owner, and every role that
    inherits from it (``reached``: ancestors), can pass grants on.
    """
    owner = F.col("owner")
    built_in = F.array(*[
        F.struct(owner.alias("grantee"), F.lit(p).alias("privilege"), owner.alias("grantor"),
                 F.lit(False).alias("grantable"))
        for p in ("USAGE", "CREATE")
    ])
    entries = namespaces.select(
        "schema_name", "owner", F.explode(F.coalesce("acl", built_in)).alias("a")
    ).select("schema_name", "owner", "a.*")
    inherits_owner = reached.where("inherit").select(
        F.col("member").alias("grantee"), F.col("role").alias("owner"), F.lit(True).alias("_passes")
    )
    option = (
        F.col("grantable")
        | F.coalesce(F.col("grantee") == owner, F.lit(False))
        | F.coalesce("_passes", F.lit(False))
    )
    return entries.join(inherits_owner, ["grantee", "owner"], "left").select(
        "schema_name", F.coalesce("grantee", F.lit("PUBLIC")).alias("grantee"), "privilege",
        option.alias("grant_option"), "grantor",
    )


def default_privileges_by_schema(default_acl: DataFrame) -> DataFrame:
    """Privileges on future objects by schema, grantee, object type and grantor."""
    return default_acl.groupBy(
        "schema_name", F.coalesce("grantee", F.lit("PUBLIC")).alias("grantee"),
        P.lookup(DEFAULT_OBJECTS, F.col("object_code"), F.col("object_code")).alias("object_type"),
        "grantor",
    ).agg(
        F.array_sort(F.collect_set("privilege")).alias("privileges"),
        F.bool_or("grantable").alias("grant_option"),
    )


def physical_design(relations: DataFrame, info: DataFrame, sort_columns: DataFrame) -> DataFrame:
    """Distribution and sort keys, row skew and statistics; NULL where unknown."""
    keys = sort_columns.where(F.col("sort_position") > 0).groupBy("relation_id").agg(
        _ordered("sort_position", "column_name").alias("sort_keys")
    )
    return relations.select("relation_id").join(info, "relation_id", "left").join(
        keys, "relation_id", "left"
    ).select(
        "relation_id", "dist_style", "dist_key",
        F.when(F.col("dist_style").isNotNull(), F.coalesce("sort_keys", F.array().cast("array<string>")))
        .alias("sort_keys"),
        "skew_rows", "unsorted_pct", "stats_off",
    )


def measured_skew(df: DataFrame, key: str) -> DataFrame:
    """Row skew of a table by a candidate distribution key: biggest over mean group."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).agg(
        F.count("*").alias("keys"), F.max("_n").alias("biggest"),
        (F.max("_n") / F.avg("_n")).alias("skew_rows"),
    )


def describe_relations(sections: dict[str, DataFrame], missing: DataFrame | None = None) -> DataFrame:
    """The whole description, one row per section entry with its fields as JSON.

    ``sections`` maps a name to a frame with ``relation_id``; ``missing`` lists
    ``(relation_id, section, reason)`` for sections an engine cannot answer.
    """
    out = None
    for name, df in sections.items():
        fields = sorted(c for c in df.columns if c != "relation_id")
        body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        rows = df.select("relation_id", F.lit(name).alias("section"), body.alias("body"),
                         F.lit(None).cast("string").alias("not_applicable"))
        out = rows if out is None else out.unionByName(rows)
    if missing is not None:
        out = out.unionByName(missing.select(
            "relation_id", "section", F.lit(None).cast("string").alias("body"),
            F.col("reason").alias("not_applicable")))
    return out
