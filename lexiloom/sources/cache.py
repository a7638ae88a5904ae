"""Content-hash reuse: what is known already, and what is to be extracted."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Occurrences of one file's content; the digest makes an entry valid for good.
ENTRIES = "path string, kind string, sha string, found array<struct<word:string,n:long>>"
KEYS = ["path", "kind", "sha"]
#: Raised when extraction changes, so that older entries are misses.
FORMAT = "v1"
OWN = re.compile(r"\.?(part-[\w.-]+|_SUCCESS)(\.crc)?")


def split_reused(files: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reused, to extract) by equal keys, the content's digest among them."""
    known = cache.select(*keys).distinct()
    return files.join(known, keys, "left_semi"), files.join(known, keys, "left_anti")


def location(root: str, home: str | None = None) -> str | None:
    """A folder for a repository's entries, named by its path's digest; none where that would lie inside the repository."""
    real = os.path.realpath(root)
    home = home or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "lexiloom")
    at = os.path.join(os.path.realpath(home), hashlib.sha256(real.encode()).hexdigest())
    return None if os.path.commonpath([at, real]) == real else os.path.join(at, FORMAT)


def clear(at: str) -> int:
    """Removes the entries' own files at a ``location`` and returns their number; a folder with anything else in it stays."""
    if os.path.islink(at) or not os.path.isdir(at):
        return 0
    own = [e.path for e in os.scandir(at) if e.is_file(follow_symlinks=False) and OWN.fullmatch(e.name)]
    for path in own:
        os.unlink(path)
    for folder in (at, os.path.dirname(at)):
        if not os.listdir(folder):
            os.rmdir(folder)
    return len(own)


class ExtractionCache:
    """A Parquet table of extracted occurrences by (path, kind, digest). Any problem with it is a miss."""

    def __init__(self, spark: SparkSession, path: str, schema: str = ENTRIES):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        reader = self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        try:
            return reader.parquet(self.path)
        except Exception:
            return self.spark.createDataFrame([], self.schema)

    def add(self, entries: DataFrame) -> None:
        """Appends; entries never change, so a reader may see any part of them."""
        entries.write.mode("append").parquet(self.path)

    @staticmethod
    def digest(content) -> F.Column:
        return F.sha2(content, 256)
