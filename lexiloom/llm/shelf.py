"""Lineage cuts: intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; set to a temp folder only if unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Narrow rows that one task writes in well under a second.
ROWS_PER_FILE = 200_000


class Shelf:
    """Writes tables to the shared folder and deletes the superseded ones.

    A table read back has no lineage, survives lost executors and has exact
    statistics for the planner. A result reads the last ones, so they stay until
    ``sweep``.
    """

    roots: list[str] = []

    @staticmethod
    def sweep(spark: SparkSession) -> int:
        """Deletes the tables of every shelf of this process and returns how many shelves had some; for when all results are written."""
        n = 0
        while Shelf.roots:
            path = spark._jvm.org.apache.hadoop.fs.Path(Shelf.roots.pop())
            n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
        return n

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        Shelf.roots.append(self.root)
        self.made = 0

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``rows``: about how many there are, if known; few rows then make few files, whatever the shuffle."""
        self.made += 1
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
        path = f"{self.root}/t{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.shelf_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "shelf_path", None)
        if path:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
