"""Statement text, identifiers and report formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
UNKNOWN = "—"

# Statement heads that only read, heads that read unless a
# data-changing word follows, and those words.
READ_HEADS = (
    "select", "show", "explain", "table", "values",
    "describe", "summarize", "pivot", "unpivot",
)
SCANNED_HEADS = ("with", "from")
CHANGE_WORDS = ("insert", "update", "delete", "merge")


def fold_space(col: Column | str) -> Column:
    """Every run of white space becomes one space; single spaces need no change."""
    return F.regexp_replace(col, r"\s{2,}|[^\S ]", " ")


def fold_sql(col: Column | str, width: int = 180) -> Column:
    """Runs of white space become one space; the first ``width`` characters stay."""
    return F.substring(fold_space(col), 1, width)


def preview(col: Column | str, width: int = 120) -> Column:
    """One line of text, clipped with an ellipsis that counts as a character."""
    line = F.trim(fold_space(col))
    if width <= 0:
        return line
    short = F.concat(F.substring(line, 1, width - 1), F.lit(ELLIPSIS))
    return F.when(F.length(line) > width, short).otherwise(line)


def classify_sql(col: Column | str) -> Column:
    """``read`` or ``write`` for a logged statement; unknown heads are writes."""
    bare = F.regexp_replace(col, r"(?s)--[^\n]*|/\*.*?\*/", " ")
    bare = F.btrim(bare, F.lit(" \t\n\x0b\f\r"))
    head = F.lower(F.regexp_extract(bare, r"^\S+", 0))
    head = F.regexp_replace(head, ";+$", "")
    changes = bare.rlike(r"(?i)\b(" + "|".join(CHANGE_WORDS) + r")\b")
    return (
        F.when(bare == "", F.lit("read"))
        .when(head.isin(*READ_HEADS), F.lit("read"))
        .when(head.isin(*SCANNED_HEADS) & ~changes, F.lit("read"))
        .otherwise(F.lit("write"))
    )


def quote(col: Column | str) -> Column:
    """Double-quoted identifier."""
    name = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def qualified(schema: str = "schema_name", name: str = "relation_name") -> Column:
    return F.concat(quote(schema), F.lit("."), quote(name))


def fmt_size(col: Column | str, unknown: str = UNKNOWN) -> Column:
    """Bytes on base 1024 with one decimal, ``B`` without; NULL or negative unknown."""
    size = (F.col(col) if isinstance(col, str) else col).cast("double")
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    out = F.when(size.isNull() | (size < 0), F.lit(unknown))
    for power, unit in enumerate(units):
        form = "%.0f " if unit == "B" else "%.1f "
        scaled = size / F.lit(float(1024**power))
        out = out.when(scaled < 1024, F.format_string(form + unit, scaled))
    return out.otherwise(F.format_string("%.1f PiB", size / F.lit(float(1024**5))))


def fmt_rows(col: Column | str, unknown: str = UNKNOWN) -> Column:
    """Row count with thousands separators; NULL or negative is unknown."""
    rows = F.col(col) if isinstance(col, str) else col
    return F.when(rows.isNull() | (rows < 0), F.lit(unknown)).otherwise(
        F.format_number(rows.cast("bigint"), 0)
    )
