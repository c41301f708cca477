"""Landed API listings: pages of JSON to rows, and which pages are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where a listing may keep its items, in the order tried; `$` is a bare list.
ITEM_PATHS = ("$.data", "$.result.data", "$.result.result", "$.result", "$.tags", "$")
_CHUNK = 4096


def page_items(text: Column | str) -> Column:
    """Items of one page as an array of variants, NULL when there is no list."""
    page = F.try_parse_json(text)
    return F.coalesce(*[F.try_variant_get(page, p, "array<variant>") for p in ITEM_PATHS])


def read_pages(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """One row per item of every landed page.

    A page is a line, or a whole file with ``one_per_file``. ``item`` is a variant;
    take fields with ``try_variant_get``, so spelling variants stay a ``coalesce``.
    Unreadable pages and empty ones give no rows.
    """
    pages = spark.read.text(path, wholetext=one_per_file)
    return pages.select(F.explode(page_items("value")).alias("item"))


def field(item: str, *names: str, as_type: str = "string") -> Column:
    """First present spelling of an item's field."""
    return F.coalesce(*[F.try_variant_get(item, f"$.{n}", as_type) for n in names])


def missing_pages(pages: DataFrame) -> DataFrame:
    """Pages a complete listing would have and the landed one has not.

    ``pages`` is ``(resource, page, page_size, count, total, total_pages)`` with
    pages counted from 0. The total of pages beats the count of items, which beats
    the total of items. Only incomplete resources are expanded, in two steps, so
    no row ever holds a long list of page numbers.
    """
    items = F.coalesce(F.max("count"), F.max("total"))
    needed = F.ceil(items / F.max("page_size")).cast("bigint")
    landed = pages.select("resource", "page").distinct()
    wanted = pages.groupBy("resource").agg(
        F.coalesce(F.max("total_pages").cast("bigint"), needed).alias("_needed")
    )
    have = landed.groupBy("resource").agg(F.count("*").alias("_have"), F.max("page").alias("_last"))
    incomplete = wanted.join(have, "resource").where(
        (F.col("_needed") > 0) & ((F.col("_have") < F.col("_needed")) | (F.col("_last") >= F.col("_needed")))
    )
    last = F.col("_needed") - 1
    chunks = incomplete.select(
        "resource", last.alias("_end"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(_CHUNK).cast("bigint"))).alias("_from"),
    )
    stop = F.least(F.col("_from") + _CHUNK - 1, F.col("_end"))
    expected = chunks.select("resource", F.explode(F.sequence(F.col("_from"), stop)).alias("page"))
    return expected.join(landed, ["resource", "page"], "left_anti")
