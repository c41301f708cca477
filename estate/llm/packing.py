"""Packing into length buckets whose bounds waste the least padding.

Documents are cut into pieces of at most the sequence length. The lengths of all pieces
are counted over the whole corpus; there are at most as many as the sequence length, so
this histogram has a proven bound and the driver may hold it. Dynamic programming over
it finds the bucket bounds with the least padding. Inside a bucket every piece is padded
to the bound, and batches are filled up to a budget of tokens.

Numbering the pieces of a bucket needs no task that sees a whole bucket: pieces are
numbered inside many small slices of it, and the sizes of the slices before are added.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estate.llm.common import SPACE_CLASS
from estate.session import materialize

MAX_LENGTH = 2048
BUCKETS = 16
BATCH_TOKENS = 32_768
SLICES = 512


def bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` bounds, each a length that occurs, with the least padding.

    ``best[i]`` is the least padding of the i shortest lengths; one more bucket in each
    round. Of equal solutions the one with the smaller bounds wins.
    """
    lengths = np.array(sorted(n for n in histogram if n > 0), np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    pieces = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    size = len(lengths)
    best = np.concatenate(([0], lengths * pieces[1:] - tokens[1:]))
    cuts = [np.zeros(size + 1, np.int64)]
    for _ in range(1, min(buckets, size)):
        fresh, cut = best.copy(), np.zeros(size + 1, np.int64)
        for i in range(1, size + 1):
            padding = best[:i] + lengths[i - 1] * (pieces[i] - pieces[:i]) - (tokens[i] - tokens[:i])
            cut[i] = int(np.argmin(padding))
            fresh[i] = padding[cut[i]]
        best = fresh
        cuts.append(cut)
    out, i = [], size
    for cut in reversed(cuts):
        if i == 0:
            break
        out.append(int(lengths[i - 1]))
        i = int(cut[i])
    return sorted(out)


def word_count(text: str = "text") -> Column:
    """A length for texts without a tokenizer at hand: the number of words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0))


def pack(
    docs: DataFrame, length: Column, key: str = "doc_id", max_length: int = MAX_LENGTH, buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``n_tokens``, ``bucket``,
    ``bucket_length``, ``batch``, ``slot``.

    A document of n tokens gives pieces of ``max_length`` and a last one with the rest.
    ``bucket`` counts from 0 by length, ``batch`` inside the bucket, ``slot`` inside the
    batch; a batch has ``batch_tokens // bucket_length`` slots, one at least. Documents
    without tokens, null texts among them, have no piece. Which slot a piece gets
    follows from its key alone; rows that agree in key are in any order. No column but
    the key and those in ``length`` is read. An empty table gives no rows.
    """
    long = docs.select(F.col(key).alias("doc_id"), length.cast("bigint").alias("_n")).where("_n > 0")
    pieces = long.select(
        "doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {max_length}"))).alias("piece")
    ).select(
        "doc_id", "piece", (F.col("piece") * max_length).alias("start"),
        F.least(F.col("_n") - F.col("piece") * max_length, F.lit(max_length)).cast("bigint").alias("n_tokens"),
    )
    pieces = materialize(pieces, "pieces")
    counted = pieces.groupBy("n_tokens").count().collect()  # at most max_length rows
    ends = bounds({r["n_tokens"]: r["count"] for r in counted}, buckets) or [max_length]
    which = F.lit(len(ends) - 1)
    for n in range(len(ends) - 2, -1, -1):
        which = F.when(F.col("n_tokens") <= ends[n], F.lit(n)).otherwise(which)
    cut = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int")
    placed = pieces.withColumn("bucket", which).withColumn("_slice", cut)
    sizes = placed.groupBy("bucket", "_slice").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("bucket", "_slice").orderBy("doc_id", "piece")
    numbered = placed.withColumn("_row", F.row_number().over(inside) - 1)
    # At most buckets * slices rows.
    numbered = numbered.join(F.broadcast(offsets), ["bucket", "_slice"])
    to = F.element_at(F.array(*[F.lit(n) for n in ends]), F.col("bucket") + 1).cast("bigint")
    slots = F.greatest(F.expr(f"{batch_tokens} div bucket_length"), F.lit(1))
    place = F.col("_before") + F.col("_row")
    return (
        numbered.withColumn("bucket_length", to).withColumn("_slots", slots).withColumn("_place", place)
        .select(
            "doc_id", "piece", "start", "n_tokens", "bucket", "bucket_length",
            F.expr("_place div _slots").alias("batch"), (F.col("_place") % F.col("_slots")).cast("int").alias("slot"),
        )
    )
