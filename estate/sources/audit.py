"""Audit logs of runs: a tolerant reader, an append-only writer, state backups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate.functions.times import at

_LOG = (
    "generated_at string, dry_run boolean, source string, "
    "renames array<struct<database: string, schema: string, old_name: string, new_name: string, kind: string>>, "
    "_corrupt string"
)


def read_rename_log(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Applied renames of all runs, one row per entry.

    Unreadable, non-object, dry-run and undated records are skipped, as are
    entries without a database, schema or new name; the rest still counts.
    """
    logs = (
        spark.read.schema(_LOG)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("multiLine", one_per_file)
        .json(path)
    )
    when = F.try_to_timestamp("generated_at").cast("timestamp_ntz")
    entries = logs.where(
        F.col("_corrupt").isNull() & ~F.coalesce("dry_run", F.lit(False))
    ).select(when.alias("generated_at"), F.explode("renames").alias("r"))
    whole = [F.coalesce(F.col(f"r.{c}"), F.lit("")) != "" for c in ("database", "schema", "new_name")]
    return entries.where(F.col("generated_at").isNotNull() & whole[0] & whole[1] & whole[2]).select(
        F.col("r.database").alias("target"), F.col("r.schema").alias("schema_name"),
        F.col("r.old_name").alias("old_name"), F.col("r.new_name").alias("new_name"),
        "generated_at", F.lit(False).alias("dry_run"),
    )


def write_audit(df: DataFrame, path: str, run_ts: datetime, dry_run: bool) -> None:
    """Append one run's rows; earlier runs are never touched."""
    stamped = df.withColumns({
        "run_ts": at(run_ts),
        "run_date": at(run_ts).cast("date"),
        "dry_run": F.lit(dry_run),
    })
    stamped.write.mode("append").partitionBy("run_date").json(path)


def backup_state(state: DataFrame, plan: DataFrame, path: str) -> None:
    """Keep the state, before a rewrite, of exactly the connections it changes."""
    changing = plan.where(F.col("action").startswith("rewrite")).select("connection_id")
    state.join(changing, "connection_id", "left_semi").write.mode("errorifexists").json(path)
