"""BI users: id lists, name lookups, filters, group changes, rosters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.plans.shapes import hot_join


def id_list(col: Column | str) -> Column:
    """Whole-number ids of a JSON list mixing numbers and ``{"id": number}``.

    Anything else in the list is ignored; text that is no list gives no ids.
    """
    items = F.try_variant_get(F.try_parse_json(col), "$", "array<variant>")

    def one(item: Column) -> Column:
        inner = F.try_variant_get(item, "$.id", "variant")
        return F.coalesce(
            F.when(F.schema_of_variant(item) == "BIGINT", F.try_variant_get(item, "$", "bigint")),
            F.when(F.schema_of_variant(inner) == "BIGINT", F.try_variant_get(inner, "$", "bigint")),
        )

    return F.coalesce(
        F.array_compact(F.transform(items, one)), F.array().cast("array<bigint>")
    )


def resolve_ids(names: DataFrame, dimension: DataFrame) -> DataFrame:
    """Ids of names in any case; ``missing`` marks names nobody has.

    ``dimension`` is ``(id, name)``; of several ids for one name the smallest counts.
    """
    known = dimension.groupBy(F.lower("name").alias("_key")).agg(F.min("id").alias("id"))
    wanted = names.select("name").distinct().withColumn("_key", F.lower(F.trim("name")))
    return wanted.join(known, "_key", "left").select(
        "name", "id", F.col("id").isNull().alias("missing")
    )


def filter_users(
    users: DataFrame,
    roles: Sequence[int] = (),
    match: str = "any",
    ids: Sequence[int] = (),
    emails: Sequence[str] = (),
) -> DataFrame:
    """Users by role set (exact, subset of, or any of ``roles``), id and e-mail.

    A user without roles never passes a role filter.
    """
    if match not in ("exact", "subset", "any"):
        raise ValueError(f"match must be exact, subset or any, got {match!r}")
    if ids:
        users = users.where(F.col("user_id").isin(*ids))
    if emails:
        users = users.where(F.lower("email").isin(*[e.lower() for e in emails]))
    if roles:
        wanted = F.array(*[F.lit(r).cast("bigint") for r in roles])
        inside = F.size(F.array_except("role_ids", wanted)) == 0
        covers = F.size(F.array_except(wanted, F.col("role_ids"))) == 0
        passes = {"exact": inside & covers, "subset": inside,
                  "any": F.arrays_overlap("role_ids", wanted)}[match]
        users = users.where((F.size("role_ids") > 0) & passes)
    return users


def group_change_plan(
    users: DataFrame,
    add: Sequence[int] = (),
    remove: Sequence[int] = (),
    set_: Sequence[int] | None = None,
) -> DataFrame:
    """New group sets; users whose groups stay the same are left out.

    ``set_`` replaces all groups, an empty one clears them, and it excludes the
    other two.
    """
    if set_ is not None and (add or remove):
        raise ValueError("set_ cannot be combined with add or remove")
    ids = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    before = F.array_sort(F.array_distinct("group_ids"))
    if set_ is not None:
        after = ids(set_)
    else:
        after = F.array_except(F.array_union("group_ids", ids(add)), ids(remove))
    after = F.array_sort(F.array_distinct(after))
    return users.where(~after.eqNullSafe(before)).select(
        "user_id", before.alias("groups_before"), after.alias("groups_after"), "role_ids"
    )


def user_roster(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with full name and role names; an id nobody named is shown as it is."""
    wanted = users.select("user_id", F.posexplode("role_ids").alias("_i", "role_id"))
    named = hot_join(wanted, roles.select("role_id", "role_name"), ["role_id"], "left",
                     by=["user_id"])
    label = F.coalesce("role_name", F.col("role_id").cast("string"))
    names = named.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_i"), label.alias("_n")))).alias("_names")
    )
    part = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    return users.join(names, "user_id", "left").select(
        "user_id", "username", F.concat_ws(" ", part("first_name"), part("last_name")).alias("full_name"),
        "email", "active",
        F.coalesce(F.array_join(F.transform("_names", lambda n: n["_n"]), ", "), F.lit("")).alias("roles"),
    )


def member_roster(users: DataFrame, dimension: DataFrame, ids: str, key: str, name: str) -> DataFrame:
    """Roles or groups with the number of users in each, zeros included."""
    counts = (
        users.select(F.explode(F.array_distinct(ids)).alias(key))
        .groupBy(key).agg(F.count("*").alias("_n"))
    )
    return dimension.join(counts, key, "left").select(
        key, name, F.coalesce("_n", F.lit(0)).cast("bigint").alias("users")
    )
