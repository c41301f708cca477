"""MinHash near-duplicates with sequential Bayesian verification.

Documents with the same shingle set are one class; everything after works on classes.
Signatures are banded. In every bucket the members are first compared with one that
leads it: each class with the leader of most of its buckets, then, where these did not
link them, with the other leaders. Of what the pairs link, components are formed; then
members of one leader that are still in different components are compared, so no link
between components is left out and none inside one is paid for. Not all pairs of them
are looked at: two that are similar differ from their leader in much the same shingles,
so an exact prefix filter on these differences tells which pairs can be.

A comparison looks at the signatures batch by batch. After each batch, the posterior of
the similarity, given the matches so far and a flat prior, tells whether the threshold
can still be reached; below the chosen miss probability the pair is dropped. Pairs that
get through all batches are verified exactly on their full sets.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate.llm.common import ship
from estate.llm.wordhash import chunks, join, mix
from estate.plans.shapes import member_filter
from estate.session import discard, materialize, release, scratch_path

BANDS, ROWS = 32, 5
BATCH = 32
MISS = 1e-6
# So many entries of a batch are made together.
ENTRIES = 1_000_000
# Shingles that one in so many members differ in are ordered by their number. Any value
# gives the same links.
USUAL = 16
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _MASKS = (_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1), _SEEDS.astype(np.uint32)


def _sets(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows of a chunk, sorted in each row, and where rows begin.

    A row with fewer words than a shingle has its whole sequence as its one shingle.
    """
    rows, out, begin = len(starts) - 1, [], [0]
    shingle = words
    for n in range(1, size):
        shingle = join(shingle[:-1], words[n:]) if len(words) > n else shingle[:0]
    for r in range(rows):
        a, b = int(starts[r]), int(starts[r + 1])
        if b - a >= size:
            found = np.unique(shingle[a : b - size + 1])
        elif b > a:
            whole = words[a : a + 1]
            for w in range(a + 1, b):
                whole = join(whole, words[w : w + 1])
            found = mix(whole + np.uint64(b - a))
        else:
            found = words[:0]
        out.append(found)
        begin.append(begin[-1] + len(found))
    return np.concatenate(out) if out else words[:0], np.array(begin)


def _signatures(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Signature of every row that has shingles, 32-bit minima of multiplied shingles."""
    starts = begin[:-1][np.diff(begin) > 0]
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), BANDS * ROWS), np.uint32)
    work = np.empty_like(short)
    for n in range(BANDS * ROWS):
        np.bitwise_xor(short, _MASKS[n], out=work)
        np.multiply(work, _FACTORS[n], out=work)
        work ^= work >> np.uint32(15)
        np.multiply(work, np.uint32(0x85EBCA6B), out=work)
        out[:, n] = np.minimum.reduceat(work, starts)
    return out


def least_matches(threshold: float, miss: float, hashes: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes compared, matches needed) after each batch.

    With a flat prior the posterior after m matches of n is Beta(m + 1, n - m + 1); the
    chance that the similarity reaches the threshold is a binomial sum.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_id`` (of the whole set) and ``signature`` per row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, many, hashes, starts in chunks(batch["text"], lower=True):
                shingles, begin = _sets(hashes, starts, words)
                n = np.diff(begin)
                ids: list[bytes | None] = [None] * many
                marks: list[np.ndarray | None] = [None] * many
                found = _signatures(shingles, begin) if len(shingles) else []
                for row, signature in zip(np.flatnonzero(n).tolist(), found):
                    ids[row] = _set_id(shingles[begin[row] : begin[row + 1]])
                    marks[row] = signature.view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, many), pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(marks, pa.list_(pa.int32()))],
                    ["doc_id", "n_shingles", "set_id", "signature"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_id binary, signature array<int>")


def _set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _full_sets(docs: DataFrame, needed: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``set_id`` and the full sorted ``shingles`` of the classes in ``needed``."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    # Texts of other classes are not dealt out; the join tells the few that get through.
    rows = member_filter(rows, "_key", needed.select("doc_id"))
    texts = rows.join(needed, F.col("_key").eqNullSafe(F.col("doc_id"))).select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch["set_id"].to_pylist()
            for first, many, hashes, starts in chunks(batch["text"], lower=True):
                shingles, begin = _sets(hashes, starts, words)
                # A key can stand for two texts; only the one that was asked for counts.
                found = [shingles[begin[r] : begin[r + 1]] for r in range(many)]
                fits = [r for r in range(many) if _set_id(found[r]) == wanted[first + r]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([wanted[first + r] for r in fits], pa.binary()),
                     pa.array([found[r].view(np.int64) for r in fits], pa.list_(pa.int64()))],
                    ["set_id", "shingles"],
                )

    return texts.mapInArrow(run, "set_id binary, shingles array<bigint>")


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) that no batch of their signatures rules out."""
    needed = least_matches(threshold, miss)
    marks = classes.select("set_id", "signature")
    both = (
        pairs.join(marks.withColumnsRenamed({"set_id": "a", "signature": "sa"}), "a")
        .join(marks.withColumnsRenamed({"set_id": "b", "signature": "sb"}), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                batch[c].flatten().to_numpy().reshape(len(batch), -1) for c in ("sa", "sb")
            )
            alive, matches, done = np.arange(len(batch)), np.zeros(len(batch), np.int64), 0
            for n, least in needed:
                matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
                alive, matches, done = alive[matches >= least], matches[matches >= least], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs whose full sets reach the similarity, written to the shared folder."""
    likely = materialize(_plausible(pairs, classes, percent / 100, miss), "likely-pairs")
    both = (
        likely.join(sets.withColumnsRenamed({"set_id": "b", "shingles": "sb"}), "b")
        .join(sets.withColumnsRenamed({"set_id": "a", "shingles": "sa"}), "a")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for left, right in zip(batch["sa"], batch["sb"]):
                x, y = left.values.to_numpy(), right.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                fits.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return materialize(both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """``set_id`` and ``label``, the smallest node of its component, for linked nodes.

    Large-star and small-star rounds on the link table, each written to the shared
    folder, until nothing changes. No neighbourhood is gathered: each node gets its
    smallest neighbour by an aggregate and hands it on by a join.
    """

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if small:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("_least")).select("a", F.least("a", "_least").alias("m"))
        joined = both.join(least, "a")
        moved = joined.where("m != b").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if small:
            return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = materialize(star(materialize(star(edges, False), "large-star"), True), "small-star")
    return edges.select(F.col("a").alias("set_id"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("set_id"), F.col("b").alias("label")).distinct()
    )


def _entries(rows: DataFrame, percent: int) -> DataFrame:
    """The prefixes of what members differ in from their leader, a row for each shingle.

    ``rows`` has ``set_id``, ``label``, ``outside``, sizes ``n`` and ``led_n``, ``name`` (a
    number for the leader), ``differ`` and the leader's ``usual`` shingles with ``counts``.
    Rare ones come first; ``key`` names shingle and leader, ``pos`` is the place and ``r``
    the size of the difference.
    """
    far, near = 100 - percent, 100 + percent
    columns = ["set_id", "label", "outside", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, places, sizes, made = [], [], [], [], 0
            own, n, led_n = (batch[c].to_pylist() for c in ("outside", "n", "led_n"))
            names = batch["name"].to_numpy().view(np.uint64)

            def out() -> pa.RecordBatch:
                fields = batch.select(columns).take(pa.array(np.concatenate(at)))
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), *fields.columns,
                     pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))],
                    ["key", *columns, "r", "pos"],
                )

            for row, (differ, usual, counts) in enumerate(zip(batch["differ"], batch["usual"], batch["counts"])):
                rest, common = differ.values.to_numpy(), usual.values.to_numpy()
                weight = np.ones(len(rest), np.int64)
                if len(common):
                    order = np.argsort(common)
                    found = np.minimum(np.searchsorted(common, rest, sorter=order), len(common) - 1)
                    hits = common[order[found]] == rest
                    weight[hits] = counts.values.to_numpy()[order[found[hits]]]
                pos = np.arange(len(rest))
                # A similar set differs from this one in so many shingles at most.
                fits = pos * percent <= n[row] * far
                if not own[row]:
                    # Similar to one that is not so to the leader: see _across.
                    fits &= pos * (2 * near) < near * len(rest) + far * (n[row] - led_n[row])
                pos = pos[fits]
                rest = rest[np.lexsort((rest, weight))[: len(pos)]]
                at.append(np.full(len(pos), row))
                keys.append(mix(rest.view(np.uint64) ^ names[row]))
                places.append(pos.astype(np.int32))
                sizes.append(np.full(len(pos), len(weight), np.int32))
                made += len(pos)
                if made >= ENTRIES:
                    yield out()
                    keys, at, places, sizes, made = [], [], [], [], 0
            if made:
                yield out()

    return rows.select("set_id", "label", "outside", "n", "led_n", "name", "differ", "usual", "counts").mapInArrow(
        run, "key bigint, set_id binary, label binary, outside boolean, n int, r int, pos int"
    )


def _across(led: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one leader in different components that can be similar.

    Let R be what a member and its leader L differ in. Two members x and y differ in what
    Rx and Ry differ in: in at most q (|x| + |y|) shingles where they are similar, with
    q = (100 - percent) / (100 + percent). So (q (|x| + |y|) + |Rx| - |Ry|) / 2 shingles of
    Rx at most are not in Ry, half of that sum where Rx is not the larger one. One of the
    two, y, is in another component than L, so |Ry| > q (|y| + |L|), as pairs with L have
    all been compared; less than (|Rx| + q (|x| - |L|)) / 2 of Rx are then not in Ry, and
    some are. In any order, the first shingle in both stands within these bounds.

    Rare ones of a leader's members come first, which is what a member was changed to in
    places of its own, and no other has them, however many the members are.
    """
    label = F.coalesce("label", "set_id").alias("label")
    labelled = led.select("lead", "set_id").join(found, "set_id", "left").select("lead", "set_id", label)
    mixed = (
        labelled.groupBy("lead").agg(F.min("label").alias("_x"), F.max("label").alias("_y"))
        .where("_x != _y").select("lead")
    )
    leads = mixed.join(found.select(F.col("set_id").alias("lead"), F.col("label").alias("_of")), "lead", "left")
    outside = (F.col("label") != F.coalesce("_of", "lead")).alias("outside")
    members = labelled.join(leads, "lead").select("lead", "set_id", "label", outside)
    its = sets.select(F.col("set_id").alias("lead"), F.col("shingles").alias("_its"))
    differ = F.concat(F.array_except("shingles", "_its"), F.array_except("_its", "shingles"))
    differences = materialize(
        members.join(sets, "set_id").join(its, "lead").select(
            F.xxhash64("lead").alias("name"), "set_id", "label", "outside", F.size("shingles").alias("n"),
            F.size("_its").alias("led_n"), differ.alias("differ"),
        ),
        "differences",
    )
    # Shingles that one in USUAL members or more differ in: few for each leader.
    counted = differences.select("name", F.explode("differ").alias("_s")).groupBy("name", "_s").agg(F.count("*").alias("_n"))
    sizes = differences.groupBy("name").agg(F.count("*").alias("_members"))
    usual = (
        counted.where("_n > 1").join(sizes, "name").where(F.col("_n") * USUAL >= F.col("_members"))
        .groupBy("name").agg(F.collect_list(F.struct("_s", "_n")).alias("_usual"))
        .select("name", F.col("_usual._s").alias("usual"), F.col("_usual._n").alias("counts"))
    )
    none = F.array().cast("array<bigint>")
    rows = differences.join(usual, "name", "left").withColumns(
        {"usual": F.coalesce("usual", none), "counts": F.coalesce("counts", none)}
    )
    entries = materialize(_entries(rows, percent), "entries")
    # Where the smaller difference has its first one in common.
    short = F.expr(f"{2 * percent}L * pos <= {100 - percent}L * n")
    # Most keys are of one member alone, and are told where they are read.
    shared = materialize(
        entries.groupBy("key")
        .agg(F.bool_or(short).alias("_s"), F.bool_or("outside").alias("_o"), F.min("label").alias("_x"), F.max("label").alias("_y"))
        .where("_s and _o and _x != _y").select("key"),
        "shared-entries",
    )
    rest = member_filter(entries, "key", shared)
    x, y = rest.where(short).alias("x"), rest.alias("y")

    def first(one: str, other: str) -> Column:
        """Whether no more of one difference than two similar sets allow come before."""
        return F.expr(
            f"{2 * (100 + percent)}L * {one}.pos"
            f" <= {100 - percent}L * ({one}.n + {other}.n) + {100 + percent}L * ({one}.r - {other}.r)"
        )

    pairs = x.join(
        y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
        & F.expr("x.r <= y.r and (x.outside or y.outside)")
        & F.expr(f"100L * least(x.n, y.n) >= {percent}L * greatest(x.n, y.n)") & first("x", "y") & first("y", "x"),
    )
    return pairs.select(
        F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")
    ).distinct()


def _tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is finished: it does when the driver's
    garbage is collected, which may else come long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, miss: float = MISS
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked when their sets of ``words``-word shingles, with A to Z as
    small letters, have a Jaccard similarity of ``percent`` in a hundred or more.
    ``component_id`` is the smallest key a document reaches over links, and the row with
    that key is kept. A document with fewer words is its whole sequence; without any
    word, null texts among them, it is linked with nothing and kept. A null key is
    passed over as a smallest one unless all are null. Rows that agree in key share
    their fate. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "signatures")
    signatures(docs, key, text, words).write.parquet(path)
    marked = spark.read.parquet(path)
    classes = materialize(
        marked.where("set_id is not null").groupBy("set_id")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
             F.first("signature").alias("signature")),
        "classes",
    )
    rows = materialize(marked.drop("signature"), "rows")
    discard(spark, path)
    band = F.expr(
        f"explode(transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, slice(signature, i * {ROWS} + 1, {ROWS}))))"
    )
    banded = classes.select("set_id", band.alias("bucket"))
    shared = materialize(
        banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets"
    )
    members = materialize(banded.join(shared, "bucket"), "members")
    # The member that shares most buckets with others leads a bucket: a text that many
    # were copied from is nearer to each of them than they are to one another.
    weights = materialize(members.groupBy("set_id").agg(F.sum("n").alias("weight")), "weights")
    leads = materialize(
        members.join(weights, "set_id").groupBy("bucket")
        .agg(F.max(F.struct("weight", "set_id")).alias("_lead"))
        .select("bucket", F.col("_lead.set_id").alias("lead")),
        "leads",
    )
    led = materialize(
        members.join(leads, "bucket").where("set_id != lead").groupBy("lead", "set_id").agg(F.count("*").alias("n")), "led"
    )
    # Full sets of all classes that share a bucket, read from the documents once.
    ends = led.select("set_id").unionByName(led.select(F.col("lead").alias("set_id"))).distinct()
    needed = materialize(classes.select("set_id", "doc_id").join(ends, "set_id"), "needed-sets")
    # A key given twice with one text gives the same set twice.
    sets = materialize(_full_sets(docs, needed, key, text, words).dropDuplicates(["set_id"]), "sets")
    release(shared, weights, leads, needed)
    _tidy(spark)
    best = led.groupBy("set_id").agg(F.max(F.struct("n", "lead")).alias("_best"))
    tested = materialize(best.select(F.col("_best.lead").alias("a"), F.col("set_id").alias("b")), "first-pairs")
    links = _links(tested, classes, sets, percent, miss)
    found = materialize(components(links), "components")
    _tidy(spark)

    def more(pairs: DataFrame, found: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        """Components with the links among untested ``pairs`` (a, b), and those pairs."""
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), label)
        links = _links(pairs, classes, sets, percent, miss)
        known = found.select(F.col("set_id").alias("a"), F.col("label").alias("b"))
        out = materialize(components(known.unionByName(links)), "components")
        _tidy(spark)
        return out, pairs

    # The other leads of a class, where its component is still another one.
    named = led.select(F.col("lead").alias("a"), F.col("set_id").alias("b"))
    ends = [found.select(F.col("set_id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
    apart = (
        named.join(ends[0], "a", "left").join(ends[1], "b", "left")
        .where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    )
    found, pairs = more(apart, found, "second-pairs")
    tested = materialize(tested.unionByName(pairs), "tested")

    # Pairs of members of one leader whose ends are still in different components.
    across = _across(led, found, sets, percent)
    tested = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found, _ = more(across, found, "third-pairs")

    grouped = rows.join(found, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "set_id").alias("label"))
    least = materialize(
        grouped.where("label is not null").groupBy("label")
        .agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n"),
        "smallest",
    )
    return grouped.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
