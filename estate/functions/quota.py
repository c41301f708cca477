"""Quota text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted units, in megabytes.
UNIT_MB = {"MB": 1, "GB": 1024, "TB": 1024 * 1024}
_SHAPE = r"(?i)^([0-9]+)\s*(MB|GB|TB)$"


def parse_quota(col: Column | str) -> Column:
    """Struct ``(text, mb, unlimited, valid)``; ``mb`` is NULL when unlimited."""
    raw = F.trim(col)
    unlimited = F.upper(raw) == "UNLIMITED"
    amount = F.nullif(F.regexp_extract(raw, _SHAPE, 1), F.lit("")).try_cast("bigint")
    unit = F.upper(F.regexp_extract(raw, _SHAPE, 2))
    valid_amount = F.coalesce(amount > 0, F.lit(False))
    factor = F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in UNIT_MB.items()])
    return F.struct(
        F.when(unlimited, F.lit("UNLIMITED"))
        .when(valid_amount, F.concat_ws(" ", amount.cast("string"), unit))
        .alias("text"),
        F.when(valid_amount, amount * factor).cast("bigint").alias("mb"),
        F.coalesce(unlimited, F.lit(False)).alias("unlimited"),
        F.coalesce(unlimited | valid_amount, F.lit(False)).alias("valid"),
    )
