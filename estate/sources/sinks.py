"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

_NESTED = (ArrayType, MapType, StructType, VariantType)


def flatten_for_export(df: DataFrame, missing: str = "N/A") -> DataFrame:
    """All columns in name order as text: nested values as JSON, NULL as ``N/A``."""
    cells = []
    for name in sorted(df.columns):
        nested = isinstance(df.schema[name].dataType, _NESTED)
        text = F.to_json(name) if nested else F.col(name).cast("string")
        cells.append(F.coalesce(text, F.lit(missing)).alias(name))
    return df.select(*cells)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result as CSV with a header or as JSON lines; one file per task."""
    if fmt == "csv":
        nested = [f.name for f in df.schema if isinstance(f.dataType, _NESTED)]
        plain = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        plain.write.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"format must be csv or json, got {fmt!r}")
