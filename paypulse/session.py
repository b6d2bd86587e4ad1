"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Everything a cluster operator may want to override stays overridable through
# ``extra`` or spark-submit --conf; these are the settings the operators expect.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "paypulse", master: str | None = None, **extra: str) -> SparkSession:
    """A UTC session with adaptive execution; ``extra`` takes conf keys with ``.`` written as ``__``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Parts that a scan is cut into for each core. With one for each, as Spark does it, those that don't fit make a second round of
#: tasks, as long as the first; records of compressed JSON cost far more than their bytes.
SPLITS_A_CORE = 4
_LEAST_SPLITS = "spark.sql.files.minPartitionNum"


@contextmanager
def fine_splits(spark: SparkSession) -> Iterator[None]:
    """Scans planned within it, and by streams started within it, have several parts for each core. Spark's least size of a part, 4 MB,
    still holds. A session that says how many parts it wants keeps that."""
    if spark.conf.get(_LEAST_SPLITS, None) is not None:
        yield
        return
    spark.conf.set(_LEAST_SPLITS, str(SPLITS_A_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(_LEAST_SPLITS)


def together(spark: SparkSession, *steps: Callable[[], object]) -> None:
    """Runs steps that don't need each other at the same time, so that one's last tasks leave no cores idle.

    All of them end before an error is raised, that of the first step that has one.
    """
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    for step in running:
        step.result()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    A machine-local temporary folder is used only where the setting is missing and
    the session is a local one; on a cluster the missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="paypulse-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
