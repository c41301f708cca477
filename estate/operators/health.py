"""Platform overview: one roll-up of all systems, and what engines cannot answer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate.plans.concurrent import WIDTH, side_by_side
from estate.session import materialize
from estate.sources.snapshot import error_of

# Fixed values, as reports show them.
# What each engine lacks, with the reason a report shows. An engine without an
# entry for a section answers it.
ENGINES = ("postgresql", "redshift", "duckdb")
CAPABILITIES = (
    "roles", "role_password_store", "concurrent_sessions", "matview_catalog",
    "acl_introspection", "relation_size_functions", "rename_with_dependents",
    "schema_privileges", "schema_alter",
)
LACKS = {
    ("redshift", "role_password_store"): "password verifiers are masked",
    ("redshift", "matview_catalog"): "materialized views have no catalog of their own",
    ("redshift", "acl_introspection"): "grant arrays cannot be expanded",
    ("redshift", "relation_size_functions"): "sizes come from a table overview instead",
    ("duckdb", "roles"): "there are no users or roles",
    ("duckdb", "role_password_store"): "there are no users, hence no passwords",
    ("duckdb", "concurrent_sessions"): "it runs in one process without other sessions",
    ("duckdb", "matview_catalog"): "there are no materialized views",
    ("duckdb", "acl_introspection"): "there are no grantees",
    ("duckdb", "relation_size_functions"): "only row estimates are kept per relation",
    ("duckdb", "rename_with_dependents"): "a rename fails while a view depends on the table",
    ("duckdb", "schema_privileges"): "there is no GRANT",
    ("duckdb", "schema_alter"): "schemas cannot be altered",
}


_REPORT = (
    "position int, system string, target string, available boolean, figure string, value double, "
    "error string, message string"
)


def capability_table(spark: SparkSession) -> DataFrame:
    """The matrix as rows; its size is fixed by the code above."""
    rows = [
        (engine, section, (engine, section) not in LACKS, LACKS.get((engine, section)))
        for engine in ENGINES
        for section in CAPABILITIES
    ]
    return spark.createDataFrame(rows, "engine string, section string, available boolean, reason string")


def coverage(targets: DataFrame, capability: DataFrame) -> DataFrame:
    """Sections each target's engine cannot answer, with the reason.

    ``capability`` is the fixed matrix (27 rows), so it is broadcast.
    """
    missing = capability.where(~F.col("available")).select("engine", "section", "reason")
    return targets.join(F.broadcast(missing), "engine").select("target", "engine", "section", "reason")


def _figures(df: DataFrame) -> DataFrame:
    numbers = [c for c in df.columns if c != "target"]
    return df.select("target", *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(
        ["target"], numbers, "figure", "value"
    )


def _section(position: int, system: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The figures of one system, written to the shared folder."""
    found = _figures(build())
    answered = found.select("target", F.lit("reachable").alias("figure"), F.lit(1.0).alias("value")).distinct()
    return materialize(found.unionByName(answered).select(
        F.lit(position).alias("position"), F.lit(system).alias("system"), "target",
        F.lit(True).alias("available"), "figure", "value",
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("message"),
    ), "section")


def health(
    spark: SparkSession, sections: Sequence[tuple[str, Callable[[], DataFrame]]], width: int = WIDTH,
    limit_s: float | None = None,
) -> DataFrame:
    """One row per system, target and figure, in the given order of systems.

    Each section builds a frame with ``target`` and numeric figures. Up to ``width`` run
    side by side, each written to the shared folder by itself: a section that fails, when
    built or when run, or takes longer than ``limit_s`` seconds, costs one row with the
    type and the text of its error and leaves the others alone. ``reachable`` is a figure
    like any other, 1 for every target that answered and 0 for a section that did not. A
    NULL figure means unknown, not zero.
    """
    jobs = {
        (position, system): partial(_section, position, system, build)
        for position, (system, build) in enumerate(sections, start=1)
    }
    failed: list[tuple] = []
    out = None
    for (position, system), found in side_by_side(spark, jobs, width, limit_s).items():
        if isinstance(found, Exception):
            failed.append((position, system, None, False, "reachable", 0.0, *error_of(found)))
        else:
            out = found if out is None else out.unionByName(found)
    problems = spark.createDataFrame(failed, _REPORT)
    return problems if out is None else out.unionByName(problems)
