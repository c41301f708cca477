"""Exact deduplication by deterministic block naming, in DataFrame functions only.

The bytes of a text are cut into blocks of a fixed size. Each block gets an integer
name, then each adjacent pair of names gets one, and so on until one name is left.
Together with the number of bytes, which fixes the shape of the tree, that name is the
identity of the text.

A name is a 128-bit integer in two halves, drawn from what it names. That names stand
for one thing each is not assumed but checked on every run: all blocks and all pairs
are grouped by name, and a name found with two contents makes the run start over with
the next salt. Equal copies are combined before they are shuffled, so a block shared by
a third of all documents is compared once per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate.plans.shapes import hot_join
from estate.session import materialize

BLOCK_BYTES = 1024
_IDENTITY = ["_bytes", "_a", "_b"]


def _block(i: str, size: int) -> str:
    return f"substring(_bin, {i} * {size} + 1, {size})"


def _named(salt: int, *parts: str) -> str:
    of = ", ".join(parts)
    return f"named_struct('a', xxhash64({2 * salt}, {of}), 'b', xxhash64({2 * salt + 1}, {of}, 'b'))"


def _bytes_of(docs: DataFrame, text: str, *keep) -> DataFrame:
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"))


def _bound(expression: str) -> str:
    """An expression over ``_bin``, bound to the bytes of the row.

    As a plain column it would be put in as the expression it comes from, and every
    block would turn the whole text into bytes once more.
    """
    return f"element_at(transform(array(_data), _bin -> {expression}), 1)"


def _blocks(size: int) -> str:
    return f"sequence(0L, greatest((octet_length(_bin) + {size - 1}) div {size}, 1L) - 1L)"


def _tree(size: int, salt: int, leaf) -> str:
    """The names of all pairs of a text, lowest level first, and the last name.

    Every pair is kept as (level, name, left, right); the last one of a level may have
    no right. The state of the fold is the current level and all pairs so far.
    """
    pair_type = (
        "array<struct<level:int,a:bigint,b:bigint,la:bigint,lb:bigint,ra:bigint,rb:bigint>>"
    )
    left, right = "get(acc.at, 2 * i)", "get(acc.at, 2 * i + 1)"
    name = _named(salt, f"{left}.a", f"{left}.b", f"{right}.a", f"{right}.b")
    up = f"transform(sequence(0L, (size(acc.at) + 1) div 2 - 1L), i -> {name})"
    pairs = (
        f"transform(sequence(0L, (size(acc.at) + 1) div 2 - 1L), i -> named_struct("
        f"'level', level, 'a', {name}.a, 'b', {name}.b, 'la', {left}.a, 'lb', {left}.b, "
        f"'ra', {right}.a, 'rb', {right}.b))"
    )
    all_pairs = f"concat(acc.pairs, {pairs})" if leaf else "acc.pairs"
    # The level count of a binary tree over the blocks; zero for one block.
    levels = f"cast(ceil(log2((octet_length(_bin) + {size - 1}) div {size})) as int)"
    steps = f"if(octet_length(_bin) <= {size}, cast(array() as array<int>), sequence(1, {levels}))"
    first = f"transform({_blocks(size)}, i -> {_named(salt, _block('i', size))})"
    return (
        f"aggregate({steps}, named_struct('at', {first}, 'pairs', cast(array() as {pair_type})), "
        f"(acc, level) -> named_struct('at', {up}, 'pairs', {all_pairs}))"
    )


def _collision(docs: DataFrame, text: str, size: int, salt: int) -> bool:
    """Whether some name of this salt stands for two different contents."""
    data = _bytes_of(docs, text)
    block = (
        data.select(F.explode(F.expr(_bound(f"transform({_blocks(size)}, i -> {_block('i', size)})"))).alias("_block"))
        .select(F.expr(_named(salt, "_block")).alias("_n"), "_block")
        .groupBy("_n.a", "_n.b", "_block").agg(F.lit(1))
        .groupBy("a", "b").count().where("count > 1").select("a", "b")
    )
    pair = (
        data.where(F.octet_length("_data") > size)
        .select(F.explode(F.expr(_bound(f"{_tree(size, salt, True)}.pairs"))).alias("_p")).select("_p.*")
        .groupBy("level", "a", "b", "la", "lb", "ra", "rb").agg(F.lit(1))
        .groupBy("level", "a", "b").count().where("count > 1").select("a", "b")
    )
    return not block.unionByName(pair).isEmpty()


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their bytes are. Of equal texts the row with the largest key
    stays, and ``keep_id`` is its key. Null texts count as empty ones, and all empty
    texts are one group. A null key is smaller than any other. Of rows that agree in
    key and text one stays. Other columns are not read. An empty table gives no rows.
    """
    salt = 0
    while _collision(docs, text, block_bytes, salt):
        salt += 1
    named = _bytes_of(docs, text, F.col(key).alias("doc_id")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("_row"),
        F.octet_length("_data").alias("_bytes"),
        F.expr(_bound(f"{_tree(block_bytes, salt, False)}.at[0]")).alias("_name"),
        F.sha2("_data", 256).alias("text_sha256"),
    ).select("doc_id", "_row", "_bytes", F.col("_name.a").alias("_a"), F.col("_name.b").alias("_b"), "text_sha256")
    ids = materialize(named, "block-names")
    # Only groups of two and more go into the join, so it is small, and salted for hot groups.
    groups = (
        ids.groupBy(*_IDENTITY)
        .agg(F.max(F.struct("doc_id", "_row")).alias("_last"), F.count("*").alias("_size"))
        .where("_size > 1")
    )
    joined = hot_join(ids, groups, _IDENTITY, "left", by=["_row"])
    alone = F.col("_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_last.doc_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("_row") == F.col("_last._row"))).alias("kept"),
        "text_sha256",
    )
