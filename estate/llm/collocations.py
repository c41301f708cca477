"""Phrase collocations from weighted acyclic automata.

A task numbers the words of a shard of texts, sorts its phrases and builds from them a
count transducer that reads language and words and gives the count. The transducer is cut
by prefix range: a phrase goes to the range its language and its words but for a last
fourth one are dealt to, so whatever follows a frequent word or pair is spread, and a
range gets each phrase of a shard once. Per range the transducers of all shards are united
as they come in, their weights summed; what stays under the least count goes.

The parts of a candidate are looked up by composition: requests and counts are dealt to
the same ranges, each side becomes a transducer, and both are walked in step.

Memory follows the shard (``SHARD_WORDS``) and the range (``RANGE_BYTES`` of text each,
so their number grows with the input), not the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate.llm import count_transducer as ct
from estate.llm.common import ship
from estate.llm.wordhash import join
from estate.plans.shapes import hot_join, spread, top_k
from estate.session import materialize

# Fixed values of the contract: characters that end a piece; small letters; blanks.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_END = b"."
_PLAIN = bytes(46 if b in _ENDS else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))

SHARD_WORDS = 2_000_000
# A word of its own takes memory beside its number.
SHARD_NEW_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
RANGE_BYTES = 8 << 20
MERGE_STATES = 2_000_000
REQUESTS = 200_000
_SALTS = 4


class _Numbers(dict):
    """A number for every word, given when it is first asked for; number 0 ends a piece."""

    def __init__(self) -> None:
        super().__init__({_END: 0})
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.bytes += len(word)
        return number


def _blocks(text: bytes) -> Iterator[bytes]:
    """A text in blocks of about a million bytes that end where a word does."""
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES
        if end < len(text):
            places = [p for p in (text.find(b" ", end), text.find(_END, end)) if p >= 0]
            end = min(places, default=len(text))
        yield text[at:end]
        at = max(end, at + 1)


class _Shard:
    """Words of texts as numbers, up to a size; then a transducer of their phrases."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self._clear([], [])

    def _clear(self, words: list[np.ndarray], roots: list[np.ndarray]) -> None:
        self.numbers = _Numbers()
        self.words, self.roots, self.size = words, roots, sum(map(len, words))

    def full(self) -> bool:
        return self.size >= SHARD_WORDS or self.numbers.bytes >= SHARD_NEW_BYTES

    def add(self, lang: bytes, block: bytes) -> None:
        tokens = block.replace(_END, b" . ").split()
        words = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
        # A language has a blank before it, so that it is no word.
        root = self.numbers[b" " + lang]
        self.words.append(words)
        self.roots.append(np.full(len(words), root, np.int32))
        self.size += len(words)

    def close(self, whole: bool) -> ct.Transducer | None:
        """The phrases so far. Unless texts end here, the last words wait for the next shard."""
        if not self.size:
            return None
        words, roots = np.concatenate(self.words), np.concatenate(self.roots)
        labels = list(self.numbers)
        until = len(words) if whole else max(0, len(words) - self.longest + 1)
        rest, rest_roots = words[until:].tolist(), roots[until:].tolist()
        out = ct.from_stream(np.where(words == 0, -1, words), roots, labels, self.longest, until)
        self._clear([], [])
        if rest:
            self.words = [np.array([self.numbers[labels[w]] for w in rest], np.int32)]
            self.roots = [np.array([self.numbers[labels[r]] for r in rest_roots], np.int32)]
            self.size = len(rest)
        return out


def _homes(of: ct.Transducer, ranges: int) -> list[np.ndarray]:
    """The range of every state, from the labels that lead to it, but for a last one."""
    hashes = np.array([zlib.crc32(w) for w in of.labels], np.uint64)
    names, out = np.zeros(1, np.uint64), []
    for depth, level in enumerate(of.levels):
        before = names[level.parent]
        names = join(before, hashes[level.label])
        last = depth == len(of.levels) - 1 and depth > 1
        out.append(((before if last else names) % np.uint64(ranges)).astype(np.int64))
    return out


def _shards(docs: DataFrame, lang: str, text: str, longest: int, ranges: int) -> DataFrame:
    """One row per shard and range: the counts of the shard's phrases that belong there."""
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")
    ).where("text is not null")

    def parts(of: ct.Transducer | None) -> Iterator[pa.RecordBatch]:
        if of is None:
            return
        ids, data, size = [], [], 0
        for home, part in ct.split(of, _homes(of, ranges)):
            ids.append(home)
            data.append(ct.encode(part))
            size += len(data[-1])
            if size > BLOCK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["home", "counts"])
                ids, data, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["home", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(longest)
        for batch in batches:
            langs, texts = batch["lang"].cast(pa.binary()), batch["text"].cast(pa.binary())
            for row in range(len(batch)):
                own = langs[row].as_py()
                for block in _blocks(texts[row].as_py().translate(_PLAIN)):
                    shard.add(own, block)
                    if shard.full():
                        yield from parts(shard.close(whole=False))
                shard.add(own, _END)
        yield from parts(shard.close(whole=True))

    return rows.mapInArrow(run, "home bigint, counts binary")


def _bare(roots: pa.Array) -> pa.Array:
    """Languages without the blank before them."""
    return pc.utf8_slice_codeunits(roots.cast(pa.string()), 1)


def _united(shards: DataFrame, least: int) -> DataFrame:
    """Phrases with their counts, ``least`` at least, and the number of words per language.

    The rows of a range follow one another, so a task holds one range at a time.
    """

    def rows(of: ct.Transducer) -> Iterator[pa.RecordBatch]:
        for depth, columns, weight in ct.phrases(of, least):
            if depth == 0:
                continue
            names = pc.binary_join_element_wise(*columns[1:], pa.scalar(b" ", pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [_bare(columns[0]), names.cast(pa.string()), pa.array(np.full(len(names), depth), pa.int32()),
                 pa.array(weight, pa.int64())],
                ["lang", "phrase", "words", "f"],
            )
        roots, singles = of.levels[0], of.levels[1]
        total = np.zeros(len(roots.label), np.int64)
        np.add.at(total, singles.parent, singles.weight)
        yield pa.RecordBatch.from_arrays(
            [_bare(of.labels.take(pa.array(roots.label))),
             pa.nulls(len(total), pa.string()), pa.array(np.zeros(len(total)), pa.int32()), pa.array(total, pa.int64())],
            ["lang", "phrase", "words", "f"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held, size = None, [], 0
        for batch in batches:
            for own, data in zip(batch["home"].to_pylist(), batch["counts"]):
                if own != home and held:
                    yield from rows(ct.union(held))
                    held, size = [], 0
                home = own
                held.append(ct.decode(data.as_py()))
                size += held[-1].size()
                if size > MERGE_STATES and len(held) > 1:
                    # Counted anew from none: a large union waits until as much has come in.
                    held, size = [ct.union(held)], 0
        if held:
            yield from rows(ct.union(held))

    return shards.mapInArrow(run, "lang string, phrase string, words int, f bigint")


def phrase_counts(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, longest: int = 4
) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and count ``f`` of all phrases of one to ``longest``
    words that occur ``least`` times or more in their language, written to the shared
    folder; rows without a phrase add up to the number of words of a language.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.select(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    shards = _shards(docs, lang, text, longest, ranges)
    tasks = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = shards.repartition(tasks, "home").sortWithinPartitions("home")
    return materialize(_united(dealt, least), "phrase-counts")


def _cut(phrase: str, first: Column, many: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, many), " ")


def _answers(counted: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with the count ``f`` of each ``part``, by composition within ranges."""
    ranges = -(-asked.count() // REQUESTS) or 1
    # A part that many phrases share is asked for in several places.
    # Both sides come from one table; new names keep their columns apart.
    left = counted.select(
        F.col("lang").alias("of"), F.col("phrase").alias("known"), F.col("f").alias("weight"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"),
        F.pmod(F.xxhash64("lang", "phrase"), F.lit(ranges)).alias("home"),
    )
    right = asked.select(
        "*", spread(_SALTS, "phrase", "k").alias("salt"), F.pmod(F.xxhash64("lang", "part"), F.lit(ranges)).alias("home")
    )

    def made(lang: pa.ChunkedArray, phrase: pa.ChunkedArray) -> list[list[bytes]]:
        pairs = zip(lang.cast(pa.binary()).to_pylist(), phrase.cast(pa.binary()).to_pylist())
        return [[b" " + name, *words.split(b" ")] for name, words in pairs]

    none = pa.schema([
        ("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("first", pa.bool_()), ("f", pa.int64())])

    def run(counts: pa.Table, requests: pa.Table) -> pa.Table:
        # A part occurs at least as often as its phrase, so each request meets its count.
        if not len(requests):
            return none.empty_table()
        have, _ = ct.from_phrases(made(counts["of"], counts["known"]), counts["weight"].to_pylist())
        want, ends = ct.from_phrases(made(requests["lang"], requests["part"]), [1] * len(requests))
        weight = ct.follow(have, want)
        found = [int(weight[depth][state]) for depth, state in ends]
        return requests.select(["lang", "phrase", "k", "first"]).append_column("f", pa.array(found, pa.int64()))

    return left.groupBy("home", "salt").cogroup(right.groupBy("home", "salt")).applyInArrow(
        run, "lang string, phrase string, k int, first boolean, f bigint"
    )


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, longest: int = 4, top: int = 2000,
    covered: int = 80,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``,
    ``r``, ``n``, ``score``.

    Texts, A to Z as small letters, end pieces at ``.,;:!?`` and line ends; words stand
    between blanks. ``n`` counts the words of a language, ``a`` the places of a phrase of
    two to ``longest`` words, all of it within a piece; ``least`` are needed. Cut in two,
    the parts occur ``l`` and ``r`` times; the score is ``2000000 * a`` by ``l + r``,
    rounded down, of the cut where it is lowest, the first of equal ones. A phrase goes
    if a longer one holds it that occurs ``covered`` percent as often or more. Order:
    score, ``a``, then the phrase by its bytes.

    Null texts have no words; a null language is ``und``, an empty one is its own. Keys
    are not read, so repeated rows count as often as they are there. A text of any
    length is cut into blocks between words. Other columns are not read. An empty table
    gives no rows.
    """
    counted = phrase_counts(docs, lang, text, least, longest)
    phrases = counted.where("words > 0")
    found = counted.where("words > 1")
    cuts = found.select("lang", "phrase", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    asked = cuts.select(
        "lang", "phrase", "k",
        F.explode(F.array(
            F.struct(F.lit(True).alias("first"), _cut("phrase", F.lit(1), F.col("k")).alias("part")),
            F.struct(F.lit(False).alias("first"), _cut("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("part")),
        )).alias("_one"),
    ).select("lang", "phrase", "k", "_one.first", "_one.part")
    # Each phrase tells those it holds how often it occurs.
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda many: F.transform(
            F.sequence(F.lit(1), F.col("words") - many + 1),
            lambda first: F.array_join(F.slice(F.split("phrase", " "), first, many), " ")),
    ))
    held = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("longer"))
    told = (
        found.select("lang", "phrase", F.col("f").alias("a"))
        .unionByName(_answers(phrases, asked), allowMissingColumns=True)
        .unionByName(held, allowMissingColumns=True)
    )
    ks = range(1, longest)
    sides = {f"{side}{k}": F.max(F.when((F.col("k") == k) & (F.col("first") == (side == "l")), F.col("f"))) for k in ks for side in "lr"}
    whole = told.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.max("longer").alias("longer"), *[c.alias(name) for name, c in sides.items()]
    )
    wide = "cast({} as decimal(20, 0))"
    cut = [
        F.when(F.col(f"l{k}").isNotNull(), F.struct(
            F.expr(f"(2000000 * {wide.format('a')}) div ({wide.format(f'l{k}')} + {wide.format(f'r{k}')})").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in ks
    ]
    lowest = F.array_min(F.filter(F.array(*cut), lambda c: c.isNotNull()))
    covers = F.expr(f"100 * {wide.format('longer')} >= {covered} * {wide.format('a')}")
    scored = (
        whole.where(~F.coalesce(covers, F.lit(False))).withColumn("_cut", lowest)
        .select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    )
    first = top_k(scored, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    totals = counted.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return hot_join(first, totals, ["lang"], by=["phrase"]).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
