"""Reading snapshots, uniting targets, and running a user's own query."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estate.functions.text import classify_sql
from estate.operators.storage import page
from estate.plans.concurrent import WIDTH, side_by_side
from estate.schemas import schema_of
from estate.session import materialize

# What a report keeps of an error's text.
ERROR_WIDTH = 160


def error_of(problem: Exception) -> tuple[str, str]:
    """Type and first characters of what went wrong."""
    return type(problem).__name__, " ".join(str(problem).split())[:ERROR_WIDTH]


def run_sql(
    spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], write: bool = False
) -> DataFrame:
    """Run a query over named tables, exactly as it is written.

    A statement that is not plainly a read is refused unless ``write`` is given. The
    names exist only while the statement is resolved; a name that is already taken
    in the session is refused, so two callers never see each other's tables.
    """
    # A row of the plan itself: classified where the plan is made, without a job.
    kind = spark.sql("VALUES (1)").select(classify_sql(F.lit(sql))).first()[0]
    if kind != "read" and not write:
        raise ValueError("the statement may write; pass write=True to run it")
    made: list[str] = []
    try:
        for name, df in tables.items():
            if spark.catalog.tableExists(name):
                raise ValueError(f"the name {name!r} is taken in this session")
            df.createTempView(name)
            made.append(name)
        return spark.sql(sql)
    finally:
        for name in made:
            spark.catalog.dropTempView(name)


def run_sql_page(
    spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], order_by: Sequence[str], limit: int,
    number: int = 1,
) -> DataFrame:
    """One page of a read query, with ``has_more``; the query is wrapped, not changed."""
    return page(run_sql(spark, sql, tables), order_by, limit, number)


def read_snapshot(
    spark: SparkSession,
    kind: str,
    path: str | None = None,
    jdbc: Mapping[str, str] | None = None,
) -> DataFrame:
    """One snapshot table under its declared schema.

    From landed Parquet files, or over JDBC with the options Spark takes
    (``url``, ``query`` or ``dbtable``, ``partitionColumn``, ``numPartitions`` ...),
    where filters and columns are pushed to the database.
    """
    schema = schema_of(kind)
    if (path is None) == (jdbc is None):
        raise ValueError("give a path or JDBC options")
    if path is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.format("jdbc").options(**jdbc).load()
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def read_optional(
    spark: SparkSession, path: str, schema: StructType | str
) -> tuple[DataFrame, bool]:
    """A source that may be absent or forbidden.

    Absent or forbidden gives an empty typed frame and ``False``, which means unknown;
    a source that is there but empty gives ``True``. Its files are listed and one row is
    looked at, so a refusal that only shows on reading is found; any other failure is
    raised.
    """
    try:
        df = spark.read.schema(schema).parquet(path)
        df.isEmpty()
        return df, True
    except Exception as problem:
        text = str(problem)
        if any(sign in text for sign in ("PATH_NOT_FOUND", "Permission denied", "AccessControlException", "AccessDenied")):
            return spark.createDataFrame([], schema), False
        raise


def union_targets(
    spark: SparkSession, reports: Mapping[str, DataFrame | Callable[[], DataFrame]], width: int = WIDTH,
    limit_s: float | None = None,
) -> tuple[DataFrame | None, DataFrame]:
    """The same report of every target as one frame, failures as a second one.

    A target given as a function is built here. Up to ``width`` targets run side by side,
    each written to the shared folder, so one that fails, when built or when run, or does
    not answer within ``limit_s`` seconds, leaves the others alone; the second frame has
    the type and the text of its error. Columns a target lacks are NULL.
    """

    def write(target: str, report: DataFrame | Callable[[], DataFrame]) -> DataFrame:
        df = report() if callable(report) else report
        return materialize(df.withColumn("target", F.lit(target)), "target")

    rows: DataFrame | None = None
    failed: list[tuple[str, str, str]] = []
    jobs = {target: partial(write, target, report) for target, report in reports.items()}
    for target, df in side_by_side(spark, jobs, width, limit_s).items():
        if isinstance(df, Exception):
            failed.append((target, *error_of(df)))
        else:
            rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    return rows, spark.createDataFrame(failed, "target string, error string, message string")
