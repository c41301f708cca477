"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
SCRATCH_KEY = "spark.estate.scratch.dir"
# Paths handed out by this process, for clear_scratch.
_MADE: list[str] = []

# Planner settings this library relies on. All are runtime settings, so they can
# be applied to a session somebody else built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # As large as the pieces it cuts: at Spark's 256 MB a hot role's part is one task's.
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; leaves sizes and parallelism to the cluster."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for cut points.

    ``spark.estate.scratch.dir`` can be set at any time and comes first; then the
    folder the cluster names in ``spark.checkpoint.dir``, which Spark lets nobody
    change at run time. Only where neither is set *and* the session is local is a
    folder made here; on a cluster it would be lost with its machine.
    """
    configured = spark.conf.get(SCRATCH_KEY, None) or spark.conf.get(_CHECKPOINT_KEY, None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SCRATCH_KEY} or {_CHECKPOINT_KEY} to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="estate-")
        spark.conf.set(SCRATCH_KEY, configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else writes to, below the shared scratch folder."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove one scratch path through Spark's file systems; absent is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _MADE:
        _MADE.remove(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every scratch path this process made. Frames read from them end here."""
    for path in list(_MADE):
        discard(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner the
    exact size of the result, so broadcasts are decided on a measured size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def transient(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Scratch made inside is removed at the end, but for what is handed to ``keep``.

        with transient(spark) as keep:
            ids = keep(many_rounds(df), "ids")

    ``keep`` writes a frame as :func:`materialize` does, so nothing lazy is left behind
    that reads what is removed. For one thread at a time.
    """
    before, kept = set(_MADE), set()

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        kept.add(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in [p for p in _MADE if p not in before and p not in kept]:
            discard(spark, path)


def release(*frames: DataFrame) -> None:
    """Remove what :func:`materialize` wrote for these frames, once nothing reads them.

    Whatever was made from them must itself have been written, as lost tasks of a lazy
    frame would look for its inputs again.
    """
    for frame in frames:
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            discard(frame.sparkSession, folder)
