"""Repeated passages by relative Lempel-Ziv parsing of every document.

The reference is what documents with smaller keys say. It is cut into phrases: all windows
of ``least`` words whose smallest ``k``-word name stands at the same place make up one
phrase, so phrases follow from the content alone and a passage is cut alike wherever it
stands. Phrases are indexed by name in blocks that Spark deals out by name; of equal ones
the index holds the first place, so a phrase that thousands of documents share is one row.

Documents are parsed from left to right against all blocks. A phrase known from a smaller
key is taken whole; phrases that follow one another here and in the reference are one
factor. At a factor's boundary the phrase is another one, though some of its windows may
be known: for phrases that share their seed with another phrase, windows are looked up one
by one, and the factor goes on to the last word it shares. A phrase that shares its seed
with none cannot hold a known window, and nothing is asked for it.

Names of phrases and windows are 128-bit digests of the words themselves. Seeds have 64
bits and only bring phrases together; equal ones decide nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate.llm.common import ship
from estate.llm.suffix_dedup import _named as run_names
from estate.llm.suffix_dedup import _smallest as leftmost_smallest
from estate.llm.wordhash import chunks
from estate.plans.shapes import hot_join, member_filter, split_members
from estate.session import materialize, release

# Fixed value of the contract: words of a window.
LEAST = 50
K = 16
_DOC = ["doc_id", "text_id"]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _joined(value: pa.Scalar) -> tuple[bytes, np.ndarray]:
    """The words of a text with one blank behind each, and where each word begins."""
    words = (value.as_py() or "").encode("utf-8").split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return b" ".join(words) + b" ", np.concatenate(([0], ends))


def _phrases_of(words: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed and first window of each phrase of a text with enough words."""
    seeds = run_names(words, k)
    at = leftmost_smallest(seeds, least - k + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return seeds[at[first]].view(np.int64), first


def _parsed(batch: pa.RecordBatch, least: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Row, seeds, first windows and number of windows of every text with enough words."""
    for top, many, words, starts in chunks(batch["text"], lower=False):
        for row in range(many):
            own = words[starts[row] : starts[row + 1]]
            if len(own) >= least:
                yield top + row, *_phrases_of(own, least, k), len(own) - least + 1


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, text and a number for the text: rows that agree in both fare alike."""
    return docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_id"), F.col(text).alias("text")
    )


def _seeds(rows: DataFrame, least: int, k: int) -> DataFrame:
    """One row per seed and document."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for row, seeds, _, _ in _parsed(batch, least, k):
                ordered = np.sort(seeds)
                found.append(ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))])
                at.append(np.full(len(found[-1]), row))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(np.concatenate(at))), pa.array(np.concatenate(found))],
                    ["doc_id", "seed"],
                )

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, seed bigint")


def _phrases(rows: DataFrame, least: int, k: int) -> DataFrame:
    """Every phrase with its seed, first window, number of windows and name."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, seeds, firsts, sizes, names = [], [], [], [], []
            for row, seed, first, windows in _parsed(batch, least, k):
                data, begin = _joined(batch["text"][row])
                size = np.diff(np.append(first, windows))
                ends = begin[first + size + least - 1]
                names += [_digest(data[a:b]) for a, b in zip(begin[first].tolist(), ends.tolist())]
                at.append(np.full(len(first), row))
                seeds.append(seed)
                firsts.append(first)
                sizes.append(size)
            if at:
                where = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(where), batch["text_id"].take(where), pa.array(np.concatenate(seeds)),
                     pa.array(np.concatenate(firsts), pa.int32()), pa.array(np.concatenate(sizes), pa.int32()),
                     pa.array(names, pa.binary())],
                    ["doc_id", "text_id", "seed", "first", "size", "name"],
                )

    return rows.mapInArrow(
        run, f"doc_id {kind}, text_id bigint, seed bigint, first int, size int, name binary"
    )


def _windows(rows: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """Every window of the phrases ``asked`` for, read at the first place of each."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    wanted = asked.select(F.xxhash64("place.doc_id", "place.text_id").alias("key")).distinct()
    rows = member_filter(rows.withColumn("_doc", F.xxhash64(*_DOC)), "_doc", wanted).drop("_doc")
    lists = asked.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.text_id").alias("text_id")).agg(
        F.collect_list(F.struct(F.col("place.first").alias("first"), "size", "name")).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                data, begin = _joined(batch["text"][row])
                windows, names, starts, offsets = [], [], [], []
                for part in batch["parts"][row].as_py():
                    for offset in range(part["size"]):
                        start = part["first"] + offset
                        windows.append(_digest(data[begin[start] : begin[start + least]]))
                        names.append(part["name"])
                        starts.append(start)
                        offsets.append(offset)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(np.full(len(names), row))), pa.array(windows, pa.binary()),
                     pa.array(names, pa.binary()), pa.array(offsets, pa.int32()), pa.array(starts, pa.int32())],
                    ["doc_id", "window", "name", "offset", "start"],
                )

    return rows.join(lists, _DOC).select("doc_id", "text", "parts").mapInArrow(
        run, f"doc_id {kind}, window binary, name binary, offset int, start int"
    )


def _known(rows: DataFrame, least: int, k: int) -> DataFrame:
    """Per document that holds known windows, where they are and where they first stand.

    ``found`` lists ``first``, ``size`` and the place ``ref`` and ``at`` in the reference:
    whole phrases, and single windows of phrases known in part.
    """
    common = (
        _seeds(rows, least, k).groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .where("lo < hi").select("seed")
    )
    common = materialize(common, "seeds")
    phrases = materialize(_phrases(rows, least, k).join(common, "seed"), "phrases")
    index = materialize(
        phrases.groupBy("name", "seed", "size").agg(
            F.min(F.struct("doc_id", "text_id", "first")).alias("place"), F.max("doc_id").alias("hi")),
        "phrase-index",
    )
    shares = index.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    asked = materialize(index.join(shares, "seed", "left_semi").select("place", "size", "name"), "asked")
    windows = materialize(_windows(rows, asked, least), "windows")
    shared = (
        windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("ref"), F.max("doc_id").alias("hi"))
        .where("ref.doc_id < hi").select("window", "ref")
    )
    part = (
        hot_join(windows, shared, ["window"], by=["name"]).where("doc_id > ref.doc_id")
        .groupBy("name").agg(F.collect_set(F.struct("offset", "ref")).alias("known"))  # at most least - k + 1
    )
    useful = (
        index.join(part, "name", "left").where("place.doc_id < hi or known is not null")
        .select("name", "place", "known")
    )
    met = hot_join(phrases.drop("seed"), useful, ["name"], by=["doc_id", "first"])
    whole = F.array(F.struct(
        "first", "size", F.col("place.doc_id").alias("ref"), F.col("place.first").alias("at")))
    single = F.transform("known", lambda w: F.struct(
        (F.col("first") + w["offset"]).alias("first"), F.lit(1).alias("size"),
        w["ref"]["doc_id"].alias("ref"), w["ref"]["start"].alias("at")))
    entries = F.when(F.col("doc_id") > F.col("place.doc_id"), whole).otherwise(single)
    found = materialize(
        met.select(*_DOC, entries.alias("entries")).where("entries is not null")
        .groupBy(*_DOC).agg(F.array_sort(F.flatten(F.collect_set("entries"))).alias("found")),
        "found",
    )
    release(common, phrases, index, asked, windows)
    return found


def _factors(found: list[dict], least: int) -> list[dict]:
    """The greedy parse: known windows in order, each factor as long as its reference goes on."""
    out: list[dict] = []
    follows = None
    for w in found:
        if follows == (w["first"], w["ref"], w["at"]):
            out[-1]["n_words"] += w["size"]
        else:
            out.append({"start": w["first"], "n_words": w["size"] + least - 1, "ref_id": w["ref"], "ref_start": w["at"]})
        follows = (w["first"] + w["size"], w["ref"], w["at"] + w["size"])
    return out


def substring_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, k: int = K
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text``,
    ``factors``.

    A word is removed if it lies in a window of ``least`` words that also starts in a
    document with a smaller key. Words are what stands between white space, compared as
    they are; ``kept_text`` has the others joined by one blank. ``factors`` lists the
    known passages by first word, number of words, and the key and first word of the
    place they are known from; they can overlap. Windows are judged on the texts as they
    come in. Null texts have no words, texts under ``least`` words lose none. Rows of one
    key take nothing from each other. A null key is neither smaller nor larger than any:
    such rows lose nothing and take nothing. Repeated rows stay as many. A text is one
    row in one task, which needs a few times its size. Other columns are not read. An
    empty table gives no rows.
    """
    if least < 2 * k:
        raise ValueError("a window must be twice as long as a seed")
    ship(docs.sparkSession)
    rows = _rows(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = _known(rows.where("doc_id is not null"), least, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                n, gone, kept, factors = [], [], [], []
                for value, entries in zip(part["text"], part["found"]):
                    words = (value.as_py() or "").encode("utf-8").split()
                    factors.append(_factors(entries.as_py() or [], least))
                    keep = np.ones(len(words), bool)
                    for f in factors[-1]:
                        keep[f["start"] : f["start"] + f["n_words"]] = False
                    n.append(len(words))
                    gone.append(len(words) - int(keep.sum()))
                    kept.append(b" ".join([w for w, stays in zip(words, keep.tolist()) if stays] if gone[-1] else words))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, _factor_type(part["doc_id"].type))],
                    ["doc_id", "n_words", "n_removed", "kept_text", "factors"],
                )

    # Only texts that lose words are dealt out; all others are parsed where they are read.
    some, none = split_members(
        rows.withColumn("_doc", F.xxhash64(*_DOC)), "_doc", found.select(F.xxhash64(*_DOC).alias("key")).distinct())
    whole = some.join(found, _DOC, "left").select("doc_id", "text", "found").unionByName(
        none.select("doc_id", "text"), allowMissingColumns=True)
    return whole.mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, n_removed bigint, kept_text string, "
        f"factors array<struct<start:int,n_words:int,ref_id:{kind},ref_start:int>>",
    )


def _factor_type(key: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("ref_id", key), ("ref_start", pa.int32())]))
