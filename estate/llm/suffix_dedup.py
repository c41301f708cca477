"""Repeated passages by a sparse suffix array over minimiser positions.

Of all suffixes only those are kept that begin at a minimiser: the position whose k-word
name is the smallest of a window. The choice depends on the content alone, so a passage
of at least ``least`` words has the same suffixes kept wherever it stands, one at least.

Kept suffixes are brought together by their first k words, as neighbours in the suffix
array are that agree in so many; a suffix without such a neighbour ends there. Each of
the others carries its surroundings: the names of all windows of ``least`` words around
it for which it is the minimiser. Neighbours with the same surroundings are combined;
from the suffix each is extended to the left and to the right by comparing, word by
word of offset, the window names of all neighbours at once. A window that two places
share is a match; matches of a document that touch are one passage.

Names have 64 bits and stand for the words, which are not compared again: among n windows
around one seed about n * n / 2**65 pairs agree by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate.llm.common import ship
from estate.llm.wordhash import chunks, join
from estate.session import materialize

LEAST = 50
K = 16


def _named(words: np.ndarray, length: int) -> np.ndarray:
    """Names of all runs of ``length`` words, from names of runs of powers of two."""
    out, done, power, width = None, 0, words, 1
    left = length
    while left:
        if left & 1:
            part = power[done:] if out is not None else power
            out = power if out is None else join(out[: len(part)], part[: len(out)])
            done += width
        left >>= 1
        if left:
            power = join(power[:-width], power[width:]) if len(power) > width else power[:0]
            width *= 2
    return out[: max(0, len(words) - length + 1)]


def _smallest(names: np.ndarray, window: int) -> np.ndarray:
    """Position of the leftmost smallest name in every window."""
    best, at, width = names, np.arange(len(names)), 1
    while width < window:
        step = min(width, window - width)
        left, right = best[:-step], best[step:]
        first = left <= right
        at = np.where(first, at[:-step], at[step:])
        best = np.where(first, left, right)
        width += step
    return at


def _suffixes(words: np.ndarray, starts: np.ndarray, least: int, k: int) -> Iterator[tuple[int, np.ndarray, ...]]:
    """Per row with enough words: its seeds, the first window of each, and all windows."""
    for row in range(len(starts) - 1):
        own = words[starts[row] : starts[row + 1]]
        if len(own) < least:
            continue
        seeds, windows = _named(own, k), _named(own, least)
        at = _smallest(seeds, least - k + 1)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        yield row, seeds[at[first]], first, windows


def _seeds(docs: DataFrame, text: str, least: int, k: int) -> DataFrame:
    """One row per kept suffix: its ``seed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, starts in chunks(batch["text"], lower=False):
                found = [s for _, s, _, _ in _suffixes(words, starts, least, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["seed"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "seed bigint")


def _surroundings(docs: DataFrame, key: str, text: str, least: int, k: int) -> DataFrame:
    """Every kept suffix with its document, first window and the names of its windows."""
    rows = docs.select(
        F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, _, words, starts in chunks(batch["text"], lower=False):
                rows, seeds, firsts, names = [], [], [], []
                for row, seed, first, windows in _suffixes(words, starts, least, k):
                    rows.append(np.full(len(seed), top + row))
                    seeds.append(seed.view(np.int64))
                    firsts.append(first)
                    # Whole names: many windows can stand around one seed.
                    names += np.split(windows.view(np.int64), first[1:])
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].take(at), batch["row"].take(at), pa.array(np.concatenate(seeds)),
                         pa.array(np.concatenate(firsts).astype(np.int64)), pa.array(names, pa.list_(pa.int64()))],
                        ["doc_id", "row", "seed", "first", "windows"],
                    )

    return rows.mapInArrow(run, f"doc_id {kind}, row bigint, seed bigint, first bigint, windows array<bigint>")


def repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, k: int = K
) -> DataFrame:
    """One row per passage: ``doc_id``, ``start_word``, ``end_word``, ``n_words``,
    ``n_spare``.

    A passage is a run of words of one document, each inside a window of ``least`` words
    that stands at two places or more, in any documents, the same one included. Words
    are what stands between white space and are compared as they are. ``n_spare`` counts
    the windows of the passage that an earlier place (smaller key, row, position) has
    with the same surroundings: these can go without losing the last copy. Null texts
    and texts under ``least`` words have no passage; repeated rows are places of their
    own. Other columns are not read. An empty table gives no rows.
    """
    if least < 2 * k:
        raise ValueError("a passage must be twice as long as a seed")
    ship(docs.sparkSession)
    common = materialize(
        _seeds(docs, text, least, k).groupBy("seed").count().where("count > 1").select("seed"), "seeds"
    )
    kept = materialize(_surroundings(docs, key, text, least, k).join(common, "seed"), "suffixes")
    kept = kept.withColumn("around", F.xxhash64("windows"))
    place = F.struct("doc_id", "row", "first")
    distinct = materialize(
        kept.groupBy("seed", "around", "windows").agg(F.count("*").alias("n"), F.min(place).alias("place")), "surroundings"
    )
    single = distinct.select("seed", "around", "n", F.posexplode("windows").alias("offset", "name"))
    shared = single.groupBy("seed", "name").agg(F.sum("n").alias("_n")).where("_n > 1").drop("_n")
    extended = (
        single.where("n = 1").join(materialize(shared, "shared-windows"), ["seed", "name"])
        .groupBy("seed", "around").agg(F.collect_set("offset").alias("offsets"))  # at most least - k + 1
    )
    whole = distinct.where("n > 1").select(
        "seed", "around", F.sequence(F.lit(0), F.size("windows") - 1).alias("offsets"), "place"
    )
    matched = materialize(
        whole.unionByName(extended, allowMissingColumns=True).select("seed", "around", "offsets", "place"), "matches"
    )
    found = kept.select("seed", "around", "doc_id", "row", "first").join(matched, ["seed", "around"])
    spare = F.coalesce(F.col("place") != place, F.lit(False)) & F.col("place").isNotNull()
    starts = found.select(
        "doc_id", "row", F.transform("offsets", lambda o: F.col("first") + o).alias("starts"),
        F.when(spare, F.size("offsets")).otherwise(0).alias("spare"),
    )
    kind = docs.schema[key].dataType.simpleString()
    per_row = starts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("starts", "spare")).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, begin, end, spare = [], [], [], []
            for row, parts in enumerate(batch["parts"].to_pylist()):
                windows = sorted((s, p["spare"] > 0) for p in parts for s in p["starts"])
                at = np.array([s for s, _ in windows])
                cut = np.flatnonzero(np.diff(at) > least) + 1
                extra = np.array([e for _, e in windows])
                for group, spared in zip(np.split(at, cut), np.split(extra, cut)):
                    ids.append(row)
                    begin.append(int(group[0]))
                    end.append(int(group[-1]) + least)
                    spare.append(int(spared.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(ids, pa.int64())), pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
                 pa.array(spare, pa.int64())],
                ["doc_id", "start_word", "end_word", "n_spare"],
            )

    spans = per_row.select("doc_id", "parts").mapInArrow(
        run, f"doc_id {kind}, start_word bigint, end_word bigint, n_spare bigint"
    )
    return spans.select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "n_spare"
    )
