"""Storage ranking: biggest relations, totals, shares, drop candidates, pages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate.functions import predicates as P
from estate.functions import text as T
from estate.plans.shapes import spread, top_k
from estate.session import materialize

# A page that ends by this row is cut out of a top-k.
SHALLOW = 10_000
# Places of rows within a task's range, as Spark numbers them.
_PLACE_BITS = 33
# Sub-groups of a section in the passes of a capped list.
_CAP_SUBGROUPS = (256, 16, 1)


def stored_relations(relations: DataFrame, prefixes: str | Iterable[str] = ()) -> DataFrame:
    """Tables, partitioned tables and matviews in matching schemas.

    A negative row estimate means "never analysed" and becomes NULL.
    """
    rows = F.when(F.col("row_estimate") >= 0, F.col("row_estimate"))
    return (
        relations.where(F.col("relkind").isin(*P.STORED_KINDS))
        .where(P.has_prefix("schema_name", prefixes))
        .withColumn("row_estimate", rows)
    )


def top_relations(
    relations: DataFrame,
    prefixes: str | Iterable[str] = (),
    n: int = 20,
    sizeless: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` biggest relations per target.

    Targets listed in ``sizeless`` run an engine without byte sizes: they are
    ranked by rows, their sizes stay NULL, and ``ranked_by`` says so.
    """
    by_rows = F.col("target").isin(*sizeless) if sizeless else F.lit(False)
    ranked = stored_relations(relations, prefixes).withColumn(
        "ranked_by", F.when(by_rows, F.lit("rows")).otherwise(F.lit("size"))
    )
    measure = F.when(by_rows, F.col("row_estimate")).otherwise(F.col("size_bytes"))
    order = [measure.desc_nulls_last(), F.col("schema_name"), F.col("relation_name")]
    return top_k(ranked, ["target"], order, n).withColumn(
        "size_bytes", F.when(~by_rows, F.col("size_bytes"))
    )


def top_relations_report(top: DataFrame) -> DataFrame:
    """The ranking with readable sizes and row counts."""
    return top.select(
        "target", "rank", "schema_name", "relation_name",
        P.kind_label().alias("kind"),
        T.fmt_size("size_bytes").alias("size"),
        T.fmt_rows("row_estimate").alias("rows"),
        "ranked_by",
    )


def storage_summary(
    relations: DataFrame, prefixes: str | Iterable[str] = (), n: int = 20
) -> DataFrame:
    """Totals per target over *all* matches, next to the whole target.

    ``pct_of_disk`` is NULL when the matched bytes are unknown or the disk is not
    positive; a target without matches keeps its disk total.
    """
    stored = F.col("relkind").isin(*P.STORED_KINDS)
    match = stored & P.has_prefix("schema_name", prefixes)
    totals = relations.groupBy("target").agg(
        F.sum(F.when(match, F.col("size_bytes"))).alias("_known"),
        F.count_if(match).alias("matched_count"),
        F.sum(F.when(stored, F.col("size_bytes"))).alias("disk_bytes"),
    )
    matched = F.when(F.col("matched_count") == 0, F.lit(0).cast("bigint")).otherwise(F.col("_known"))
    share = F.when(
        F.col("disk_bytes") > 0, F.col("matched_bytes") * F.lit(100.0) / F.col("disk_bytes")
    )
    shown = F.least(F.col("matched_count"), F.lit(n).cast("bigint"))
    return totals.withColumn("matched_bytes", matched).select(
        "target", "matched_bytes", "matched_count", "disk_bytes",
        share.alias("pct_of_disk"),
        shown.alias("shown"),
        (F.col("matched_count") - shown).alias("remaining"),
    )


def drop_plan(top: DataFrame, summary: DataFrame) -> DataFrame:
    """One drop candidate per ranked relation, with its size and share of the target."""
    verb = F.when(F.col("relkind") == "m", F.lit("DROP MATERIALIZED VIEW ")).otherwise(
        F.lit("DROP TABLE ")
    )
    share = F.when(
        F.col("disk_bytes") > 0, F.col("size_bytes") * F.lit(100.0) / F.col("disk_bytes")
    )
    return top.join(summary.select("target", "disk_bytes"), "target", "left").select(
        "target", "rank", "schema_name", "relation_name", "size_bytes",
        share.alias("pct_of_disk"),
        F.concat(verb, T.qualified(), F.lit(";")).alias("statement"),
    )


def schema_highlights(relations: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` biggest objects with a size above zero in every schema."""
    order = [F.col("size_bytes").desc(), F.col("relation_name")]
    return top_k(
        relations.where(F.col("size_bytes") > 0), ["target", "schema_name"], order, n
    ).select("target", "schema_name", "rank", "relation_name",
             P.kind_label().alias("kind"), "size_bytes")


def _with_more(fetched: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Show ``limit`` of at most ``limit + 1`` fetched rows and whether more follow."""
    position = F.row_number().over(Window.orderBy(*order))
    count = F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        fetched.withColumns({"_pos": position, "has_more": count > limit})
        .where(F.col("_pos") <= limit)
        .drop("_pos")
    )


class Pages:
    """All pages of a frame: ranked once, then any page is read alone.

    Ranges of the order key are dealt to tasks by a sample, each task sorts its range, and
    the rows are written with the place they have in it. The rows of each range are
    counted, and what lies before a page follows by a prefix sum over as many numbers as
    there were tasks. A page reads its own stretch of one or two ranges, however deep it
    lies. Rows equal in the order key are told apart by a hash of all their columns, so
    a frequent key is no task's alone.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str | Column]) -> None:
        if not order_by:
            raise ValueError("a page needs an order key")
        self.columns = df.columns
        self.order = [F.col(c) if isinstance(c, str) else c for c in order_by]
        self.order.append(F.xxhash64(*[F.col(c).cast("string") for c in df.columns]))
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(tasks, *self.order).sortWithinPartitions(*self.order)
        self.rows = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "pages")
        counted = self.rows.groupBy(F.shiftright("_at", _PLACE_BITS).alias("range")).agg(F.count("*").alias("rows"))
        self.ranges = sorted((r["range"], r["rows"]) for r in counted.collect())

    @property
    def total(self) -> int:
        return sum(rows for _, rows in self.ranges)

    def between(self, first: int, last: int) -> DataFrame:
        """The rows ranked from ``first`` up to but not including ``last``, counted from 0."""
        wanted, before = F.lit(False), 0
        for number, rows in self.ranges:
            a, b = max(first - before, 0), min(last - before, rows)
            if a < b:
                start = number << _PLACE_BITS
                wanted = wanted | F.col("_at").between(start + a, start + b - 1)
            before += rows
        return self.rows.where(wanted)

    def page(self, number: int, limit: int) -> DataFrame:
        """One page (1-based) with a ``has_more`` column."""
        if number < 1 or limit < 1:
            raise ValueError("pages count from 1 and hold a row at least")
        first = (number - 1) * limit
        return self.between(first, first + limit).select(
            *self.columns, F.lit(self.total > first + limit).alias("has_more")
        )


def page(
    df: DataFrame, order_by: Sequence[str | Column], limit: int, number: int = 1
) -> DataFrame:
    """One page (1-based) with a ``has_more`` column; limit 0 means all rows.

    The order key is mandatory, otherwise two pages may overlap. Of a shallow page only
    ``limit + 1`` rows leave the top-k; one that ends behind row ``SHALLOW`` comes from
    :class:`Pages`, which runs when called and is worth keeping for more than one page.
    With a key to go on from, :func:`page_after` needs neither.
    """
    if not order_by:
        raise ValueError("a page needs an order key")
    if number < 1:
        raise ValueError("pages count from 1")
    if limit == 0:
        return df.withColumn("has_more", F.lit(False))
    if number * limit > SHALLOW:
        return Pages(df, order_by).page(number, limit)
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    fetched = df.orderBy(*order).offset((number - 1) * limit).limit(limit + 1)
    return _with_more(fetched, order, limit)


def page_after(df: DataFrame, key: str, last: object | None, limit: int) -> DataFrame:
    """The next page behind key ``last``; the filter reaches the scan."""
    rest = df if last is None else df.where(F.col(key) > F.lit(last))
    return _with_more(rest.orderBy(key).limit(limit + 1), [F.col(key)], limit)


def cap(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of every section and how many more there are.

    One pass over the input. A section is dealt over sub-groups; each sort of one leaves
    its first ``n`` rows, and the first of them carries how many rows stood behind it. The
    passes over ever fewer sub-groups add these up, so a hot section is never whole in one
    task.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    df = df.withColumns({"_salt": spread(_CAP_SUBGROUPS[0], *df.columns), "_rows": F.lit(1).cast("bigint")})
    for groups in _CAP_SUBGROUPS:
        own = Window.partitionBy(*keys, F.col("_salt") % groups)
        df = (
            df.withColumn("_all", F.sum("_rows").over(own))
            .withColumn("rank", F.row_number().over(own.orderBy(*by))).where(F.col("rank") <= max(n, 1))
            .withColumn("_rows", F.when(F.col("rank") == 1, F.col("_all")).otherwise(F.lit(0)))
        )
    return (
        df.where(F.col("rank") <= n)
        .withColumn("hidden", F.greatest(F.col("_all") - n, F.lit(0)).cast("bigint"))
        .drop("_salt", "_rows", "_all")
    )
