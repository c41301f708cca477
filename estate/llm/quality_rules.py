"""Quality rules: base counts and a character n-gram log-likelihood ratio, DataFrame only.

Two multinomials over all character n-grams are counted: one over the trusted texts, one
over the whole raw corpus. A document's score is the mean log ratio of its n-grams. The
trusted counts are smoothed towards the raw ones, so an n-gram nobody has evidence
about weighs nothing. Ratios are kept in millionths as integers, so the sums and the
verdicts do not depend on the order of summing. No row is sampled, in counting or in
judging, and the table of n-grams grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

from estate.llm.common import words_of
from estate.plans.shapes import split_members
from estate.session import materialize

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
GRAM = 3
PRIOR = 8192
THRESHOLD = -0.5
# A table of n-grams with more rows, of two fixed numbers each, is joined and not broadcast.
BROADCAST_ROWS = 2_000_000
_MILLION = 1_000_000


def _window_hashes(step: DataFrame) -> DataFrame:
    """``_hashes``: one hash per window of eight words, by doubling: 1, 2, 4, 8 words."""
    step = step.withColumn("_1", F.expr("transform(_words, w -> xxhash64(w))"))
    for width in (1, 2, 4):
        shifted = f"slice(_{width}, {width + 1}, size(_words))"
        step = step.withColumn(f"_{2 * width}", F.expr(f"zip_with(_{width}, {shifted}, (a, b) -> xxhash64(a, b))"))
    # The last seven reach over the end.
    return step.withColumn("_hashes", F.expr(f"slice(_8, 1, greatest(size(_words) - {WINDOW - 1}, 0))"))


def base_counts(docs: DataFrame, text: str, keep: Sequence[Column]) -> DataFrame:
    """``keep``, the words as ``_words`` and the five counts of the contract."""
    step = docs.select(*keep, F.col(text).alias("_text"), words_of(F.col(text)).alias("_words"))
    step = _window_hashes(step)
    step = step.withColumn("_twice", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    step = step.withColumn(
        "_sorted",
        F.when(F.col("_twice"), F.sort_array(F.expr("transform(_hashes, (h, i) -> struct(h, i))"))),
    )
    # Positions of windows that are next to an equal one in sorted order.
    step = step.withColumn(
        "_at",
        F.when(F.col("_twice"), F.expr(
            "sort_array(array_distinct(flatten(transform(sequence(1, size(_sorted) - 1), j -> "
            "if(get(_sorted, j).h = get(_sorted, j - 1).h, "
            "array(get(_sorted, j - 1).i, get(_sorted, j).i), cast(array() as array<int>))))))"
        )),
    )
    covered = F.expr(
        f"aggregate(sequence(0, size(_at) - 1), 0L, (n, j) -> n + "
        f"least({WINDOW}, coalesce(get(_at, j + 1) - get(_at, j), {WINDOW})))"
    )
    step = step.withColumn("_repeated", F.when(F.col("_twice"), covered).otherwise(F.lit(0).cast("bigint")))
    string = F.coalesce("_text", F.lit(""))
    lines = F.filter(F.split(string, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != "")
    step = step.withColumn("_lines", lines)
    return step.select(
        *[F.col(c) for c in step.columns[: len(keep)]],
        "_words",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(string, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.col("_repeated").alias("n_repeat_words"),
    )


def _grams(docs: DataFrame, buckets: int | None) -> DataFrame:
    """The other columns of ``docs`` and ``_gram``, a row for each n-gram of ``_words``;
    one with a null where there is none.

    The n-grams are all runs of three characters, with the words of the text parted by
    one blank and a blank on both sides, each named by 64 bits. With ``buckets`` they
    are the first and the last characters of each word alone, in so many buckets.
    """
    others = [c for c in docs.columns if c != "_words"]
    if buckets is None:
        flat = F.when(F.size("_words") > 0, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
        # Four bytes to a character, so that an n-gram is found by its place and not by a walk.
        chars = docs.select(*others, F.encode(flat, "UTF-32").alias("_chars"))
        places = F.expr(f"sequence(1, octet_length(_chars) - {4 * GRAM - 1}, 4)")
        placed = chars.select("*", F.explode_outer(places).alias("_place"))
        name = F.xxhash64(F.substring("_chars", F.col("_place"), F.lit(4 * GRAM)))
        return placed.select(*others, F.when(F.col("_place").isNotNull(), name).alias("_gram"))
    ends = (f"xxhash64(substring(_w, 1, {GRAM}))", f"xxhash64(substring(_w, -{GRAM}, {GRAM}), 1)")
    both = F.array(*[F.expr(f"if(_w is null, null, pmod({h}, {buckets}L))") for h in ends])
    return docs.select(*others, F.explode_outer("_words").alias("_w")).select(*others, F.explode(both).alias("_gram"))


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str, text: str, buckets: int | None, prior: int) -> DataFrame:
    """``_gram`` and ``_ratio``, the log ratio in millionths, of every n-gram in ``docs``.

    ``trusted`` names the trusted rows by key. Both counts cover every document, in one
    pass: a text whose key a bitmap of the trusted ones does not know is counted where it
    is read; the others, trusted but for a few, are told apart by an exact join, dealt out
    alike at every size of the labels.
    """
    known = materialize(trusted.select(F.col(key).alias("_key")).distinct(), "trusted-keys")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    some, none = split_members(texts, "_key", known)
    flags = known.withColumn("_trusted", F.lit(1).cast("bigint")).hint("merge")
    flagged = some.join(flags, "_key", "left").select("_text", F.coalesce("_trusted", F.lit(0).cast("bigint")).alias("_trusted"))
    whole = flagged.unionByName(none.select("_text", F.lit(0).cast("bigint").alias("_trusted")))
    words = whole.select("_trusted", words_of(F.col("_text")).alias("_words"))
    grams = _grams(words, buckets).where("_gram is not null")
    counted = materialize(grams.groupBy("_gram").agg(F.count("*").alias("_raw"), F.sum("_trusted").alias("_good")), "ngrams")
    p = F.col("_raw") / counted.agg(F.sum("_raw")).scalar()
    ratio = F.log((F.col("_good") + prior * p) / ((counted.agg(F.sum("_good")).scalar() + prior) * p))
    return counted.select("_gram", F.round(ratio * _MILLION).cast("bigint").alias("_ratio"))


def quality_rules(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None,
    buckets: int | None = None, prior: int = PRIOR, threshold: float = THRESHOLD,
) -> DataFrame:
    """Counts and verdict of every document: ``keep`` (default: key), the counts
    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    then ``base_failed``, ``kept``, ``log_ratio`` (mean of the n-grams, null without any).

    A document is kept when the base rules hold and its mean log ratio reaches
    ``threshold``. ``trusted`` holds the keys of trusted rows, any number of them.
    Null and empty texts have no words and fail the base rules. Repeated rows are
    judged each on their own. Columns in ``keep`` that clash with a result column give
    way to it. Without trusted rows every ratio is zero. An empty table gives no rows.
    Kept columns of a fixed width go along with the n-grams; others are written once with a
    row number and joined to the verdicts.
    """
    ratios = materialize(log_ratios(docs, trusted, key, text, buckets, prior), "log-ratios")
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio"}
    kept = [c for c in (keep or [key]) if c not in made]
    names = [f"_kept{n}" for n in range(len(kept))]
    short = all(isinstance(docs.schema[c].dataType, (NumericType, BooleanType, DateType, TimestampType)) for c in kept)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names)], F.col(text).alias("_text"))
    if not short:
        rows = materialize(rows.withColumn("_number", F.monotonically_increasing_id()), "judged-rows")
    counts = base_counts(rows, "_text", [F.col(n) for n in names] if short else [F.col("_number")])
    # The row number tells repeated rows apart. It also keeps filters on the verdict above
    # this point; pushed below, they would compute all of the counts once more for each use.
    counts = counts.withColumn("_row", F.monotonically_increasing_id())
    # There is a row on this side for every character of the corpus, which must not be dealt
    # out while the other side, as with any one alphabet, is small; its rows are counted.
    small = ratios.count() <= BROADCAST_ROWS
    step = _grams(counts, buckets).join(F.broadcast(ratios) if small else ratios, "_gram", "left")
    # The number alone is the key, made and looked up for every n-gram; the rest is the same
    # in all rows of a number.
    rest = [F.max(c).alias(c) for c in counts.columns if c not in ("_words", "_row")]
    step = step.groupBy("_row").agg(*rest, F.sum("_ratio").alias("_sum"), F.count("_gram").alias("_n"))
    if not short:
        step = step.join(rows.select("_number", *names), "_number")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    good = (F.col("_n") == 0) | (F.col("_sum") >= F.col("_n") * F.lit(int(threshold * _MILLION)))
    return step.select(
        *[F.col(n).alias(c) for c, n in zip(kept, names)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & good).alias("kept"),
        F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n") / _MILLION).alias("log_ratio"),
    )


def trusted_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of all documents labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").where(F.col(key).isNotNull()).select(key).distinct()
