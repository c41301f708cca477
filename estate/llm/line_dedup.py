"""Line deduplication by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a host if more than a given share of the host's pages contain
it. Lines are counted by their hash first. A hash never counts too few pages, so what
stays below the share is settled; the lines of the rest are then counted as they are.
A host can have at most (lines per page / ratio) such lines, so one list per host is
small, and the pages are cleaned row by row, without regrouping their lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate.llm.common import SPACES
from estate.session import materialize

RATIO = 0.1
MIN_PAGES = 5


def _pages(docs: DataFrame, host: str, text: str) -> DataFrame:
    """Host and the distinct lines with a word of every page."""
    filled = F.filter(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return docs.select(F.col(host).alias("_host"), F.array_distinct(filled).alias("_lines"))


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """One row per host that has any: ``_host`` and its boilerplate lines ``_drop``."""
    pages = _pages(docs, host, text)
    totals = pages.groupBy("_host").agg(F.count("*").alias("_total"))
    lines = pages.select("_host", F.explode("_lines").alias("_line"))
    often = (F.col("_pages") >= min_pages) & (F.col("_pages") > F.col("_total") * F.lit(float(ratio)))
    hashed = (
        lines.groupBy("_host", F.xxhash64("_line").alias("_hash"))
        .agg(F.count("*").alias("_pages"))
        .where(F.col("_pages") >= min_pages)
    )
    same = F.col("t._host").eqNullSafe(F.col("h._host"))
    suspects = materialize(
        hashed.alias("h").join(totals.alias("t"), same).where(often)
        .select("h._host", F.col("h._hash"), F.col("t._total")),
        "frequent-lines",
    )
    line = lines.withColumn("_hash", F.xxhash64("_line")).alias("l")
    both = F.col("l._host").eqNullSafe(F.col("s._host")) & (F.col("l._hash") == F.col("s._hash"))
    exact = (
        line.join(suspects.alias("s"), both)
        .groupBy("l._host", "l._line").agg(F.count("*").alias("_pages"), F.first("s._total").alias("_total"))
        .where(often)
    )
    return materialize(exact.groupBy("_host").agg(F.collect_list("_line").alias("_drop")), "boilerplate")


def line_dedup(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    counts: bool = False,
) -> DataFrame:
    """``docs`` without the boilerplate lines of their hosts; all columns stay.

    A line goes from every page of a host when at least ``min_pages`` pages and more
    than ``ratio`` of the host's pages have it. Lines end at ``\\n``; blank lines are
    neither counted nor dropped. A page counts a line once however often it repeats
    it, and every row is a page, also a repeated one. Pages with a null host form one
    host; pages with a null text count as pages without lines and keep their null. A
    page that loses all its lines keeps its row with an empty text. With ``counts``
    the columns ``n_lines`` and ``n_dropped`` follow, after any of the same name are
    dropped. An empty table gives no rows.
    """
    drop = boilerplate(docs, host, text, ratio, min_pages)
    page = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    joined = page.alias("p").join(drop.alias("d"), F.col(f"p._doc.{host}").eqNullSafe(F.col("d._host")), "left")
    split = joined.select("_doc", "_drop", F.split(F.col(f"_doc.{text}"), "\n").alias("_lines"))
    left = split.select(
        "_doc", "_lines",
        F.when(F.col("_drop").isNull(), F.col("_lines"))
        .otherwise(F.filter("_lines", lambda x: ~F.array_contains(F.col("_drop"), x))).alias("_left"),
    )
    clean = F.array_join("_left", "\n")
    out = [
        (clean if c == text else F.col(f"_doc.`{c}`")).alias(c)
        for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))
    ]
    if counts:
        n = F.coalesce(F.size("_lines"), F.lit(0)).cast("bigint")
        dropped = F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0)).cast("bigint")
        lines = F.when(F.col(f"_doc.{text}").isNull(), F.lit(0).cast("bigint"))
        out += [lines.otherwise(n).alias("n_lines"), lines.otherwise(dropped).alias("n_dropped")]
    return left.select(*out)
