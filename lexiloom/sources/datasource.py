"""A repository as a Spark data source: folders are the partitions, and listing and reading are one scan.

    register(spark)
    spark.read.format("repository").option("config", text).load(root)

The plan looks at folders only, as far as there should be partitions; what they
hold is listed and read in the tasks, so the root must be visible there.
Filters on ``path`` prune folders before they are entered. The limit of entries
holds in each partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from . import repository

SCHEMA = f"{repository.LISTED}, text string, sha string, problem string"
PARTITIONS = 64


@dataclass
class Folder(InputPartition):
    """A folder: its own entries, or all from it down."""

    order: int
    rel: str
    whole: bool


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        text = options.get("config")
        self.config = repository.Config.parse(json.loads(text)) if text else repository.Config()
        self.texts = str(options.get("texts", "true")).lower() == "true"
        self.most = int(options.get("partitions", PARTITIONS))
        self.wanted: list[tuple[str, ...]] = []  # a path must begin with one of each

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Every filter is kept for its beginnings and given back: folders are pruned by them, rows by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",):
                if isinstance(f, (EqualTo, StringStartsWith)):
                    self.wanted.append((str(f.value),))
                elif isinstance(f, In):
                    self.wanted.append(tuple(map(str, f.value)))
            yield f

    def enters(self, folder: str) -> bool:
        """Whether a wanted path may lie in a folder."""
        inside = folder + "/" if folder else ""
        return all(any(p.startswith(inside) or inside.startswith(p) for p in some) for some in self.wanted)

    def partitions(self) -> list[Folder]:
        """Folders in walk order; the shallowest are opened until there are enough."""
        plan: list[tuple[str, bool]] = [("", True)]
        while len(plan) < self.most:
            closed = [(rel.count("/") + bool(rel), i) for i, (rel, whole) in enumerate(plan) if whole]
            if not closed:
                break
            at = min(closed)[1]
            rel = plan[at][0]
            below = [folder for _, folder in repository.list_folder(self.root, rel, self.config) if folder is not None and self.enters(folder)]
            plan[at : at + 1] = [(rel, False), *((folder, True) for folder in below)]
        return [Folder(i, rel, whole) for i, (rel, whole) in enumerate(plan)]

    def entries(self, rel: str, whole: bool) -> Iterator[repository.Entry]:
        if not whole:
            yield from (e for e, folder in repository.list_folder(self.root, rel, self.config) if folder is None)
            return
        stack, n = [rel], 0
        while stack:
            below = []
            for entry, folder in repository.list_folder(self.root, stack.pop(), self.config):
                n += 1
                if n > repository.LIMITS["walk_entries"]:
                    yield repository.Entry(folder or entry.path, 0, "walk-budget")
                    return
                if folder is None:
                    yield entry
                elif self.enters(folder):
                    below.append(folder)
            stack += below[::-1]

    def read(self, partition: Folder) -> Iterator[tuple]:
        for i, e in enumerate(self.entries(partition.rel, partition.whole)):
            got = (None, None, None)
            if self.texts and e.why is None and (e.target is not None or not e.link) and self._fits(e):
                got = repository.read_file(self.root, e.target or e.path)
            yield (*e, (partition.order << 33) + i, *got)

    def _fits(self, e: repository.Entry) -> bool:
        """Whether a file is worth reading: of a known kind, within the limit, and under no name that must not be read."""
        return e.size is not None and e.size <= repository.LIMITS["file_bytes"] and not any(repository.never_read(p) for p in (e.path, e.target or e.path)) and repository.known_kind(e.path)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets its Python sources have filters, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)
