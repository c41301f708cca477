"""Top-k per group and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Above this the planner stops pruning row_number() filters before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
_PRUNED_LIMIT = 1000
# Sub-groups of a group in the passes of a big top-k; each pass leaves n rows of each.
_SUBGROUPS = (4096, 256, 16)
_SALTS = 8


def spread(salts: int, *columns: str) -> Column:
    """A salt that is the same whenever a lost task is run again."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of every group, with their position.

    For small ``n`` the planner keeps only ``n`` rows per group and task before
    the shuffle. For larger ``n``, passes over ever fewer sub-groups do the same, so
    no task sorts more than a small multiple of ``n`` rows of a hot group.
    """
    if n > _PRUNED_LIMIT:
        df = df.withColumn("_salt", spread(_SUBGROUPS[0], *df.columns))
        for salts in _SUBGROUPS:
            inner = Window.partitionBy(*keys, F.col("_salt") % salts).orderBy(*order)
            df = df.withColumn("_pos", F.row_number().over(inner)).where(F.col("_pos") <= n).drop("_pos")
        df = df.drop("_salt")
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= n)


def hot_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = _SALTS,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Join on keys that may hold a large share of ``big``.

    ``small`` has about one row per key and is usually an aggregate on these very
    keys. Joined as it is, it would not be shuffled again, and the adaptive skew
    split only works on sides that are. With the salt in the keys each hot key is
    spread over ``salts`` tasks *and* both sides are shuffled afresh, so what is
    still too big is split further at run time. ``small`` is repeated per salt, but
    not where the planner is going to broadcast it: there no key is in one task, and
    every task would hold the repeated table.
    """
    if _is_broadcast(small):
        return big.join(small, list(keys), how)
    columns = by or [c for c in big.columns if c not in keys] or list(big.columns)
    left = big.withColumn("_salt", spread(salts, *columns))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _is_broadcast(df: DataFrame) -> bool:
    """Whether the planner's estimate of ``df`` is within its limit for a broadcast."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def heavy_keys(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Keys with more than a task's share of the rows, and into how many ``pieces`` to cut them.

    Rows of a null key join with nothing and are not counted. Every heavy key holds more
    than one part in ``tasks`` of all rows, so there are fewer than ``tasks`` of them at
    any size of the input, and the result is safe to broadcast.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    shares = F.col("_n") * tasks / counts.agg(F.sum("_n")).scalar()
    return counts.withColumn("_shares", shares).where("_shares > 1").select(
        key, F.ceil("_shares").cast("int").alias("pieces")
    )


def skewed_join(left: DataFrame, right: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Inner join on a key that may hold a large share of ``left`` and many rows of ``right``.

    A first pass counts ``left`` per key. Rows of heavy keys alone are dealt over as many
    pieces as they have shares, and only the matching rows of ``right`` are repeated, once
    per piece; all other keys join plainly, with nothing repeated.
    """
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(left, key, tasks)
    one = F.coalesce(F.col("pieces"), F.lit(1))
    dealt = left.join(F.broadcast(heavy), key, "left").withColumn(
        "_piece", F.pmod(F.xxhash64(*left.columns), one).cast("int")
    )
    repeated = right.join(F.broadcast(heavy), key, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), one - 1))
    )
    return dealt.drop("pieces").join(repeated.drop("pieces"), [key, "_piece"]).drop("_piece")


# Bits of a membership bitmap per key, and at most: 16 MB in all, however many the keys.
_BITS_PER_KEY, _MOST_BITS = 64, 1 << 27
_BITMAP_BITS = 32_768  # of one row that bitmap_construct_agg makes


def _may_be_member(df: DataFrame, column: str, keys: DataFrame, bits: int | None) -> DataFrame:
    key = F.col(keys.columns[0])
    if bits is None:
        bits = min(max(_BITMAP_BITS, keys.count() * _BITS_PER_KEY), _MOST_BITS)

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(bits).cast("bigint")) + 1

    marked = keys.select(place(key).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits")
    )
    probed = df.withColumn("_p", place(F.col(column))).withColumn("_bucket", F.bitmap_bucket_number("_p"))
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0)) == 1
    return probed.join(F.broadcast(marked), "_bucket", "left").withColumn("_may", bit).drop("_p", "_bucket", "_bits")


def split_members(df: DataFrame, column: str, keys: DataFrame, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column`` may be among ``keys``, and those where it is not.

    Keys, the first column of ``keys``, are hashed into a bitmap of at most 16 MB, whose
    rows of 4 KB each are broadcast, and every row is tested where it is read: wide rows
    that are not wanted are never dealt out. Some others get through, about one in 64 and
    more the fuller the bitmap, so an exact join follows; none that is wanted is lost.
    Counts ``keys`` when called, unless the number of ``bits`` is given, so they should
    be a written table.
    """
    tested = _may_be_member(df, column, keys, bits)
    return tested.where("_may").drop("_may"), tested.where("not _may").drop("_may")


def member_filter(df: DataFrame, column: str, keys: DataFrame, bits: int | None = None) -> DataFrame:
    """The first part of :func:`split_members`."""
    return split_members(df, column, keys, bits)[0]
