"""Running independent fits side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

R = TypeVar("R")


def side_by_side(
    spark: SparkSession, tasks: Sequence[Callable[[], R]], threads: int = 4
) -> list[R]:
    """Run driver tasks in a few threads; each starts its own Spark jobs."""
    if not tasks:
        return []
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]


@contextmanager
def kept(df: DataFrame):
    """Keep a feature table at hand while several fits read it; lost parts are recomputed.

    A table that is already kept is left to the block that keeps it.
    """
    if df.storageLevel != StorageLevel.NONE:
        yield df
        return
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()
