import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use themselves.
CLASHING = ("kept", "n_words", "seed", "row", "bucket", "_row", "_doc", "_words", "signature", "n_lines", "spans", "label")


def make(spark, texts, start=0, sources=("s0", "s1")):
    rows = [
        (start + i, t, "en", sources[i % len(sources)] if sources else None, None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda texts, **more: make(spark, texts, **more)


def prose(seed, words, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""
    from pyspark.sql import functions as F

    long = prose(1, 60_000)
    rows = [
        (1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27),
        (2, "", "en", "a", 0), (3, None, "en", "a", None), (4, " \t\n\r\x0b\x0c ", None, None, 7),
        (5, long, "en", "b", len(long)), (6, long, "en", None, len(long)), (None, "no key at all", "en", "a", 13),
        (None, None, None, None, None), (7, "x", "en", "b", 1), (8, "one two three four five six", "de", "b", 27),
        (9, "ünï cödé 漢字 \U0001f600 é", "en", "b", 20), (1, "another text under the same key", "en", "a", 30),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df, rows


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
