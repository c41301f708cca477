"""Documents to packed batches: quality, lines, near duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate.llm import line_dedup, near_dup, packing, quality_rules, secrets
from estate.llm.common import documents, table
from estate.plans.shapes import split_members
from estate.session import materialize, release, transient


def _renewed(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` with a new text, and ``n_chars`` that goes with it."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows as ``_whole`` with their place: ``_file``, a number for it, and ``_row`` in it.

    Rows read from files have a place that stays; others are written once to have one.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = materialize(docs, "numbered")
    place = docs.metadataColumn("_metadata")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"),
        F.xxhash64(place["file_path"]).alias("_file"), place["row_index"].alias("_row"),
    )


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("_file", "_row", F.col("_whole.doc_id").alias("doc_id"), F.col("_whole.text").alias("text"))


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose places are kept, as they came in.

    Most are, so the dropped places are looked for: a row that a bitmap of them does not
    know passes where it is read, and only the others are dealt out with their texts.
    """
    places = rows.select("_file", "_row").join(kept, ["_file", "_row"], "left_anti")
    dropped = materialize(places, "dropped")
    named = rows.withColumn("_place", F.xxhash64("_file", "_row"))
    some, none = split_members(named, "_place", dropped.select(F.xxhash64("_file", "_row").alias("_place")))
    left = some.join(dropped, ["_file", "_row"], "left_anti")
    return none.select("_whole.*").unionByName(left.select("_whole.*"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep."""
    trusted = quality_rules.trusted_rows(table(spark, sf_dir, "labels"))
    rows = _numbered(docs)
    with transient(spark) as keep:
        judged = quality_rules.quality_rules(_plain(rows), trusted, keep=["_file", "_row"])
        kept = keep(judged.where("kept").select("_file", "_row"), "kept")
    return _only(rows, kept)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    clean = line_dedup.line_dedup(docs)
    return _renewed(clean, F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles.

    The row with the smallest key stays, of rows that agree in their key the one with the
    smallest row number. A null key is passed over as the smallest unless all are null.
    """
    rows = _numbered(docs)
    plain = _plain(rows).select(F.struct("_file", "_row").alias("_at"), "doc_id", "text")
    with transient(spark) as keep:
        found = near_dup.near_duplicates(plain, key="_at", words=5, percent=80)
        groups = found.select(F.col("doc_id").alias("_at"), "component_id").join(plain.select("_at", "doc_id"), "_at")
        first = groups.groupBy("component_id").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_at")).alias("_first")
        )
        kept = keep(first.select("_first._at._file", "_first._at._row"), "kept")
    return _only(rows, kept)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret, also those in decoded layers, masked by its kind."""
    return _renewed(secrets.mask_secrets(docs), F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in length buckets and batches."""
    return packing.pack(docs, packing.word_count())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_masks),
    ("packing", pack),
]

# Near duplicates and decoded secrets cannot be told in SQL; the stages are tested
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each written and read again.

    What a stage has written is removed when the next one has been.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
