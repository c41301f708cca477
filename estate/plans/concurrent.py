"""Independent Spark work side by side, with a width and a limit for each piece."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Hashable, Mapping
from concurrent.futures import FIRST_COMPLETED, Future, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
# Fixed value of reports: so many pieces under way at once.
WIDTH = 16
_POOL = "spark.scheduler.pool"


def _start(spark: SparkSession, job: Callable[[], T], tag: str) -> Future[T]:
    """Run ``job`` in a thread that has the caller's Spark properties, its own tag and pool."""
    done: Future[T] = Future()

    def work() -> None:
        spark.sparkContext.addJobTag(tag)
        spark.sparkContext.setLocalProperty(_POOL, tag)
        # A task that waits for a source is woken up when its job is given up.
        spark.sparkContext.setLocalProperty("spark.job.interruptOnCancel", "true")
        try:
            done.set_result(job())
        except BaseException as problem:  # noqa: BLE001 - handed on to whoever waits
            done.set_exception(problem)

    # A piece that never comes back must not keep the process from ending.
    threading.Thread(target=inheritable_thread_target(spark)(work), daemon=True).start()
    return done


def side_by_side(
    spark: SparkSession, jobs: Mapping[Hashable, Callable[[], T]], width: int = WIDTH, limit_s: float | None = None
) -> dict[Hashable, T | Exception]:
    """The result of every job, or the exception it ended with, in the order given.

    At most ``width`` jobs run at once. One that takes longer than ``limit_s`` seconds
    from its own start ends with a ``TimeoutError``: its Spark jobs are cancelled by tag
    and its place goes to the next, whether or not its thread comes back.
    """
    if width < 1:
        raise ValueError("at least one job must run at a time")
    waiting = list(jobs)
    running: dict[Future[T], tuple[Hashable, str, float]] = {}
    out: dict[Hashable, T | Exception] = {}
    while waiting or running:
        while waiting and len(running) < width:
            name, tag = waiting.pop(0), f"estate-{uuid.uuid4().hex}"
            ends = time.monotonic() + limit_s if limit_s is not None else float("inf")
            running[_start(spark, jobs[name], tag)] = (name, tag, ends)
        left = min(ends for _, _, ends in running.values()) - time.monotonic()
        done, _ = wait(running, None if left == float("inf") else max(left, 0), FIRST_COMPLETED)
        for future in done:
            problem = future.exception()
            if problem is not None and not isinstance(problem, Exception):
                raise problem
            out[running.pop(future)[0]] = future.result() if problem is None else problem
        for future, (name, tag, ends) in list(running.items()):
            if time.monotonic() >= ends:
                spark.sparkContext.cancelJobsWithTag(tag)
                out[name] = TimeoutError(f"no answer within {limit_s:g} s")
                del running[future]
    return {name: out[name] for name in jobs}
