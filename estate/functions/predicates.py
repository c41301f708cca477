"""Row predicates. Prefixes and suffixes are always literal: ``_`` is a letter."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Schemas no plan may drop or change.
PROTECTED_SCHEMAS = ("information_schema", "public", "main", "catalog_history")
# Relation kinds that hold storage.
STORED_KINDS = ("r", "p", "m")
# Kind code to label.
KIND_LABELS = {
    "r": "table",
    "v": "view",
    "m": "matview",
    "f": "foreign table",
    "p": "partitioned table",
    "S": "sequence",
    "i": "index",
}


def kind_label(kind: str = "relkind") -> Column:
    """Readable relation kind; unknown codes pass through."""
    return lookup(KIND_LABELS, F.col(kind), F.col(kind))


def lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """CASE over a small fixed mapping."""
    out = None
    for code, text in mapping.items():
        hit = key == code
        out = F.when(hit, F.lit(text)) if out is None else out.when(hit, F.lit(text))
    return out if default is None else out.otherwise(default)


def clean_prefixes(prefixes: str | Iterable[str]) -> list[str]:
    """Split comma lists, trim, drop blanks and repeats, keep first-seen order."""
    given = [prefixes] if isinstance(prefixes, str) else list(prefixes)
    parts = [p.strip() for item in given for p in item.split(",")]
    return list(dict.fromkeys(p for p in parts if p))


def has_prefix(col: str, prefixes: str | Iterable[str]) -> Column:
    """True where the column starts with any prefix; no prefix means every row."""
    wanted = clean_prefixes(prefixes)
    if not wanted:
        return F.lit(True)
    return reduce(Column.__or__, [F.col(col).startswith(p) for p in wanted])


def with_prefix(df: DataFrame, col: str, prefixes: str | Iterable[str]) -> DataFrame:
    return df.where(has_prefix(col, prefixes))


def with_suffix(df: DataFrame, col: str, suffix: str) -> DataFrame:
    return df.where(F.col(col).endswith(suffix))


def glob_pattern(pattern: str) -> str:
    """Shell-style pattern as LIKE text escaped with ``#``; ``%`` keeps its meaning."""
    return pattern.replace("#", "##").replace("_", "#_").replace("*", "%")


def glob(col: str, pattern: str) -> Column:
    """``*`` matches any run of characters, ``_`` only itself."""
    return F.like(F.col(col), F.lit(glob_pattern(pattern)), F.lit("#"))


def is_system_schema(col: str = "schema_name") -> Column:
    return F.col(col).startswith("pg_") | (F.col(col) == "information_schema")


def hide_system(df: DataFrame, col: str = "schema_name") -> DataFrame:
    return df.where(~is_system_schema(col))


def is_protected(col: str = "schema_name") -> Column:
    folded = F.lower(F.col(col))
    return folded.startswith("pg_") | folded.isin(*PROTECTED_SCHEMAS)


def split_exclusions(tokens: Iterable[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Schemas and (schema, relation) pairs named by exclusion tokens.

    Everything from ``#`` on is a comment. More than one dot is an error.
    """
    schemas: dict[str, None] = {}
    relations: dict[tuple[str, str], None] = {}
    for token in tokens:
        name = token.split("#", 1)[0].strip()
        if not name:
            continue
        parts = [p.strip() for p in name.split(".")]
        if len(parts) > 2 or not all(parts):
            raise ValueError(f"exclusion {token!r} is neither schema nor schema.relation")
        if len(parts) == 1:
            schemas[parts[0]] = None
        else:
            relations[parts[0], parts[1]] = None
    return list(schemas), list(relations)


def exclude(df: DataFrame, tokens: Iterable[str] | DataFrame) -> DataFrame:
    """Drop excluded schemas and relations.

    Tokens given as text become literals in the filter. A token table (column
    ``token``) may be of any size and is removed with two anti joins; tokens with
    more than one dot are ignored there, as a table has no place to fail.
    """
    if isinstance(tokens, DataFrame):
        name = F.trim(F.split_part(F.col("token"), F.lit("#"), F.lit(1)))
        parts = tokens.select(F.split(name, r"\s*\.\s*").alias("_p")).where(
            F.get("_p", F.lit(0)) != ""
        )
        schemas = parts.where(F.size("_p") == 1).select(F.col("_p")[0].alias("schema_name"))
        relations = parts.where(F.size("_p") == 2).select(
            F.col("_p")[0].alias("schema_name"), F.col("_p")[1].alias("relation_name")
        )
        kept = df.join(schemas, "schema_name", "left_anti")
        return kept.join(relations, ["schema_name", "relation_name"], "left_anti")
    schemas, relations = split_exclusions(tokens)
    return df.where(~is_excluded(schemas, relations))


def is_excluded(
    schemas: Sequence[str],
    relations: Sequence[tuple[str, str]],
    schema: str = "schema_name",
    relation: str = "relation_name",
) -> Column:
    tests = [F.col(schema).isin(*schemas)] if schemas else []
    if relations:
        pairs = [F.concat_ws(".", F.lit(s), F.lit(r)) for s, r in relations]
        tests.append(F.concat_ws(".", schema, relation).isin(*pairs))
    return reduce(Column.__or__, tests, F.lit(False))


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows where any column, as text, contains ``text`` in any case."""
    cells = F.array(*[F.lower(F.col(c).cast("string")) for c in df.columns])
    return df.where(F.exists(cells, lambda c: F.coalesce(c.contains(text.lower()), F.lit(False))))
