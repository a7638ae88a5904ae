"""Lineage cuts in the shared checkpoint folder, and jobs that don't wait for each other."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Jobs submitted at a time; each spreads over the cluster by itself.
AT_ONCE = 8


def folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a temp folder only where that is unset, as in tests."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


_made: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Deletes every table that ``cut`` has made in this process and returns their number; for when all results are written."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table to the shared folder and read from there.

    The table has no lineage, survives lost executors, is read by column and
    gives the planner its true size. ``sweep`` deletes it.
    """
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, **jobs: Callable):
    """{name: result} of jobs that need nothing of each other; small ones then wait for no stage but their own."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
        return {name: r.result() for name, r in running.items()}
