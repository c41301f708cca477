"""Transitive closure of an edge table, by doubling or by walking from given starts.

Without starts, paths are doubled: once all pairs up to depth ``k`` are known, those at
exactly ``k`` are continued by any known pair, which finds every pair up to ``2 k``. A
shortest path of length between the two has a node at depth ``k``, so none is missed, and
when no pair lies at exactly ``k`` none lies further. The rounds are the logarithm of the
longest shortest path, also on a cycle through all nodes, and each pair is made once per
node that halves its paths so, not once per path. With given starts only their pairs are
made, one edge at a time, and the rounds are the depth reached from them.

Pairs known so far are one table below the shared folder, bucketed by pair. What a round
finds is grouped by the same key, so it meets the known pairs in place: neither side is
shuffled for that, and known pairs are moved once per round, to be continued. Each round
is a committed write, so a lost executor costs one round. The driver sees row counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estate.session import scratch_path

# ``clean`` pairs are those over flagged edges alone; the others are over all edges.
_KEY = ("node", "reached", "clean")
_COLUMNS = (*_KEY, "depth", "via")
# Of two names and three small values each.
BROADCAST_ROWS = 50_000


class _Known:
    """The pairs found so far: a bucketed table that rounds are appended to."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        self.name = f"estate_pairs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, pairs: DataFrame, ahead: Column) -> int:
        """Add pairs; how many of them can be continued comes along without another job."""
        seen = Observation()
        (
            pairs.select(*_COLUMNS).observe(seen, F.count_if(ahead).alias("n"))
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, *_KEY).saveAsTable(self.name)
        )
        return seen.get["n"]

    def close(self) -> DataFrame:
        """The files stay, the name goes."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.path)


def _shortest(paths: DataFrame) -> DataFrame:
    """One row per pair and kind: the shortest, then the smallest last node."""
    return (
        paths.where(F.col("node") != F.col("reached"))
        .groupBy(*_KEY)
        .agg(F.min(F.struct("depth", "via")).alias("_first"))
        .select(*_KEY, F.col("_first.depth").alias("depth"), F.col("_first.via").alias("via"))
    )


def _extend(ahead: DataFrame, step: DataFrame, rows: int | None = None) -> DataFrame:
    """Paths of ``ahead``, so many ``rows`` if given, continued by one row of ``step``.

    Few are broadcast, so that ``step`` stays where it is. More are sorted and merged, as
    only there the pairs of one much reached node are cut among tasks: a broadcast that is
    chosen once ``step`` has been dealt out leaves them all to one.
    """
    head = ahead.select("node", F.col("reached").alias("_at"), "clean", F.col("depth").alias("_d"))
    tail = step.select(F.col("node").alias("_at"), "reached", "clean", "depth", "via")
    head = F.broadcast(head) if rows is not None and rows <= BROADCAST_ROWS else head.hint("merge")
    return head.join(tail, ["_at", "clean"]).select(
        "node", "reached", "clean", (F.col("_d") + F.col("depth")).alias("depth"), "via"
    )


def _fresh(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs not known yet; both sides lie by pair already."""
    return _shortest(paths).join(known.select(*_KEY), list(_KEY), "left_anti")


def _doubled(single: DataFrame, known: _Known) -> None:
    depth, ahead = 1, known.append(single, F.lit(True))
    while ahead:
        paths = _extend(known.read().where(F.col("depth") == depth), known.read(), ahead)
        depth *= 2
        ahead = known.append(_fresh(paths, known.read()), F.col("depth") == depth)


def _walked(single: DataFrame, wanted: DataFrame, known: _Known, step_path: str) -> None:
    single.write.parquet(step_path)
    step = known.spark.read.schema(single.schema).parquet(step_path)
    depth, ahead = 1, known.append(step.join(wanted, "node", "left_semi"), F.lit(True))
    while ahead:
        paths = _extend(known.read().where(F.col("depth") == depth), step, ahead)
        depth += 1
        ahead = known.append(_fresh(paths, known.read()), F.lit(True))


def closure(
    edges: DataFrame, src: str, dst: str, flag: str | None = None, starts: DataFrame | None = None
) -> DataFrame:
    """All ``(node, reached)`` pairs with ``depth``, ``via`` and ``flag``.

    ``depth`` is the length of a shortest path, ``via`` the smallest name just
    before ``reached`` on a shortest path, and ``flag`` is true when some path
    has it on every edge. A node never reaches itself. ``starts`` has the nodes
    to start from in its first column; without it every node is one. Runs its
    rounds when called; what they write goes with ``estate.session.clear_scratch``.
    """
    spark = edges.sparkSession
    root = scratch_path(spark, "closure")
    passes = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    kinds = F.when(F.col("_flag"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    single = (
        edges.select(F.col(src).alias("node"), F.col(dst).alias("reached"), passes.alias("_flag"))
        .where(F.col("node").isNotNull() & F.col("reached").isNotNull())
        .where(F.col("node") != F.col("reached"))
        .groupBy("node", "reached")
        .agg(F.max("_flag").alias("_flag"))
        .select("node", "reached", F.explode(kinds).alias("clean"), F.lit(1).alias("depth"),
                F.col("node").alias("via"))
    )
    known = _Known(spark, f"{root}/round-pairs", single.schema)
    if starts is None:
        _doubled(single, known)
    else:
        wanted = starts.select(F.col(starts.columns[0]).alias("node")).distinct()
        _walked(single, wanted, known, f"{root}/step")
    pairs = known.close()
    if flag is None:
        return pairs.select("node", "reached", "depth", "via", F.lit(True).alias("flag"))
    return (
        pairs.groupBy("node", "reached")
        .agg(F.min(F.when(~F.col("clean"), F.struct("depth", "via"))).alias("_first"), F.max("clean").alias("flag"))
        .select("node", "reached", F.col("_first.depth").alias("depth"),
                F.col("_first.via").alias("via"), "flag")
    )
