"""Repositories as a ``files`` table: a deterministic driver-side listing, reads on the executors.

Spark's file index drops names that start with ``_`` or ``.``, so the listing is
our own; it looks at names and sizes only. Contents are read in the tasks, by
path, so the root must be visible there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.fixed import DOC_EXTENSIONS, EXTENSIONS, LIMITS, ROLES, ROLE_DIRS, SENSITIVE
from ..operators import topk
from ..plans.glossaries import valid_prefix

#: Folders and files that this engine writes, and documents it reports on; never evidence.
OWN_DIRS, OWN_FILES = ("lexiloom-out",), ("GLOSSARY.md", "LEXILOOM.md")
# Files that mark the root of a package.
MANIFESTS = "package.json pyproject.toml setup.py Cargo.toml go.mod pom.xml build.gradle dune-project mix.exs composer.json Gemfile".split()
# Files that declare several projects by being there.
WORKSPACES = "pnpm-workspace.yaml lerna.json go.work WORKSPACE WORKSPACE.bazel MODULE.bazel".split()
#: Roles whose content is never evidence.
LEFT_OUT_ROLES = ("vendored", "generated")


@dataclass
class Config:
    """Literal path prefixes to ignore, and roles by prefix. A malformed file is an error."""

    ignore: list[str] = field(default_factory=list)
    roles: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, doc: dict) -> Config:
        if not isinstance(doc, dict) or set(doc) - {"schema_version", "ignore_paths", "path_roles"} or doc.get("schema_version") != 1:
            raise ValueError("a configuration has schema_version 1, ignore_paths and path_roles, nothing else")
        roles: dict[str, str] = {}
        for role, own in (doc.get("path_roles") or {}).items():
            for p in own:
                if role not in ROLES or p in roles:
                    raise ValueError(f"{p}: unknown role, or owned twice")
                roles[p] = role
        ignore = list(doc.get("ignore_paths") or [])
        if len(ignore) + len(roles) > LIMITS["config_rules"] or not all(map(valid_prefix, [*ignore, *roles])):
            raise ValueError("rules are literal relative path prefixes, at most 500")
        return cls(sorted(set(ignore)), roles)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.roles.items()), "prefix string, role string")


def named_exactly(folder: str, name: str) -> bool | None:
    """Whether a folder has an entry of exactly this name, whatever the file system says of case; null if it can't tell within the entry limit."""
    try:
        with os.scandir(folder) as it:
            for i, e in enumerate(it):
                if e.name == name:
                    return True
                if i >= LIMITS["directory_entries"]:
                    return None
    except OSError:
        return None
    return False


def _left_out(name: str, path: str, config: Config) -> str | None:
    """Why a folder isn't entered: its name, a rule, or a role that is left out while no rule names anything beneath it."""
    if re.search(SENSITIVE, name.lower()):
        return "sensitive"
    if any(path == p or path.startswith(p + "/") for p in config.ignore):
        return "ignored"
    if name.startswith("."):
        return "hidden"
    role = next((r for r in LEFT_OUT_ROLES if name.lower() in ROLE_DIRS[r]), None)
    own = max((p for p in config.roles if path == p or path.startswith(p + "/")), key=len, default=None)
    if own is not None:
        role = config.roles[own] if config.roles[own] in LEFT_OUT_ROLES else None
    return None if role is None or any(p.startswith(path + "/") for p in config.roles) else role


class Entry(NamedTuple):
    """What a listing knows of a path. ``why``: left out already; ``target``: what a link leads to inside the root; ``size``: of the content, null where it can't be read."""

    path: str
    size: int | None
    why: str | None = None
    link: bool = False
    target: str | None = None


def list_folder(root: str, rel: str, config: Config) -> list[tuple[Entry | None, str | None]]:
    """What one folder holds, folders before files, each sorted: an entry to report, or the path of a folder to enter.

    Names, sizes and links are looked at, no more of them than a folder may
    have; a folder with more is left out whole, as is one that can't be listed.
    """
    inside = os.path.realpath(root)
    try:
        with os.scandir(os.path.join(root, rel)) as it:
            here = sorted(islice(it, LIMITS["directory_entries"] + 1), key=lambda e: e.name)
    except OSError:
        return [(Entry(rel or ".", 0, "unreadable-directory"), None)]
    if len(here) > LIMITS["directory_entries"]:
        return [(Entry(rel or ".", 0, "directory-too-large"), None)]
    folders: list[tuple[Entry | None, str | None]] = []
    files: list[tuple[Entry | None, str | None]] = []
    for e in here:
        path, link = f"{rel}/{e.name}" if rel else e.name, e.is_symlink()
        try:
            folder = e.is_dir()
        except OSError:
            folder = False
        real = os.path.realpath(e.path) if link else None
        away = real is not None and os.path.commonpath([real, inside]) != inside
        if folder:
            why = "own-output" if e.name in OWN_DIRS else _left_out(e.name, path, config) or ("symlink-escapes" if away else "symlink-directory" if link else None)
            folders.append((Entry(path, 0, why), None) if why else (None, path))
            continue
        try:
            size = os.path.getsize(e.path) if not away else 0
        except OSError:
            size = None
        files.append((Entry(path, size, None, link, None if real is None or away else os.path.relpath(real, inside).replace(os.sep, "/")), None))
    return folders + files


def walk_folders(root: str, start: str, config: Config) -> Iterator[Entry]:
    """Files and unentered folders from one folder down, depth first, up to the limit of entries; own output isn't counted."""
    stack, entries = [start], 0
    while stack:
        below = []
        for entry, folder in list_folder(root, stack.pop(), config):
            if entry is None or entry.why != "own-output":
                entries += 1
                if entries > LIMITS["walk_entries"]:
                    yield Entry(folder or entry.path, 0, "walk-budget")
                    return
            if folder is not None:
                below.append(folder)
            else:
                yield entry
        stack += below[::-1]


def list_files(root: str, config: Config | None = None) -> list[Entry]:
    """The whole repository's files and unentered folders in walk order."""
    return list(walk_folders(root, "", config or Config()))


def path_verdict(path: Column, role: Column, config: Config) -> Column:
    """Why a path is no evidence, by its whole name, in order: sensitive, own output, ignored, hidden, role; null if it may be."""
    parts = F.split(path, "/")
    dirs, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    ignored = F.exists(F.array(*map(F.lit, config.ignore)), lambda p: paths.under(path, p)) if config.ignore else F.lit(False)
    return (
        F.when(F.exists(parts, lambda p: F.lower(p).rlike(SENSITIVE)), "sensitive")
        .when(name.isin(list(OWN_FILES)) | F.exists(dirs, lambda d: d.isin(list(OWN_DIRS))), "own-output")
        .when(ignored, "ignored")
        .when(F.exists(parts, lambda p: p.startswith(".")), "hidden")
        .when(role.isin(list(LEFT_OUT_ROLES)), role)
    )


LISTED = "path string, size long, why string, link boolean, target string, walk_order long"


def judge(listed: DataFrame, config: Config, links: bool = True) -> DataFrame:
    """``LISTED`` rows with kind, language, module, role and exclusion_kind (null: it may be evidence).

    A link is judged by its own name and then, by the same ordered decision, by
    the whole path of what it leads to, which the listing need not have met; the
    link's role and size are those of that content. ``links``: whether any may be there.
    """
    typed = listed.withColumns({"kind": paths.kind_of(F.col("path")), "language": paths.language_of(F.col("path")), "module": paths.module_of(F.col("path"))})
    named = listed.select("path").union(listed.where("target is not null").select("target")).distinct() if links else listed.select("path")
    named = paths.with_roles(named, config.frame(listed.sparkSession))
    judged = named.withColumn("verdict", path_verdict(F.col("path"), F.col("role"), config))
    met = typed.join(judged, "path")
    if links:
        met = met.join(judged.select(F.col("path").alias("target"), F.col("role").alias("target_role"), F.col("verdict").alias("target_verdict")), "target", "left")
    else:
        met = met.withColumns({"target_role": F.lit(None).cast("string"), "target_verdict": F.lit(None).cast("string")})
    why = F.coalesce(
        "why", "verdict", F.when(F.col("kind").isNull(), "unsupported"), F.when(F.col("link") & F.col("target").isNull(), "symlink-escapes"),
        F.when(F.col("target_verdict") == "sensitive", "sensitive").when(F.col("target_verdict").isNotNull(), "symlink-excluded"),
        F.when(F.col("size").isNull(), "unreadable").when(F.col("size") > LIMITS["file_bytes"], "too-large"),
    )
    met = met.withColumn("exclusion_kind", why).withColumn("role", F.coalesce("target_role", "role"))
    return met.select("path", F.coalesce("size", F.lit(0)).alias("size"), "walk_order", "kind", "language", "module", "role", "target", "exclusion_kind")


def classify(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """Every listed path, judged; what the corpus has no room for is excluded too: a smaller later file may still fit."""
    config = config or Config()
    rows = [(*e, i) for i, e in enumerate(list_files(root, config))]
    met = judge(spark.createDataFrame(rows, LISTED), config, any(r[4] for r in rows))
    good = met.where("exclusion_kind is null").select("path", "size", "walk_order")
    files, total = good.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    if files <= LIMITS["source_files"] and total <= LIMITS["corpus_bytes"]:
        return met
    fits = topk.greedy_budget(good, F.col("size"), LIMITS["corpus_bytes"], F.asc("walk_order")).where("admitted")
    fits = topk.top_k(fits, LIMITS["source_files"], F.asc("walk_order")).select("path", F.lit(True).alias("fits"))
    over = F.when(F.col("exclusion_kind").isNull() & F.col("fits").isNull(), "corpus-budget")
    return met.join(fits, "path", "left").withColumn("exclusion_kind", F.coalesce("exclusion_kind", over)).drop("fits")


#: What each kind of exclusion means, with the number of paths.
SENTENCES = {
    "sensitive": "%d path(s) with a name, or behind a link to a name, that may hold secrets",
    "own-output": "%d path(s) of this engine's own output, or glossaries",
    "ignored": "%d path(s) that the configuration ignores",
    "hidden": "%d hidden path(s)",
    "generated": "%d generated path(s)",
    "vendored": "%d vendored path(s)",
    "unsupported": "%d file(s) that are neither code nor prose",
    "symlink-escapes": "%d link(s) that lead out of the repository",
    "symlink-excluded": "%d link(s) to content that is itself left out",
    "symlink-directory": "%d linked folder(s), read at their own place only",
    "unreadable": "%d path(s) that can't be read",
    "unreadable-directory": "%d folder(s) that can't be listed",
    "too-large": "%d file(s) beyond the limit of a file",
    "directory-too-large": "%d folder(s) beyond the limit of entries, left out whole",
    "walk-budget": "%d path(s) at which the walk ended, and all after",
    "corpus-budget": "%d file(s) that the corpus had no room for",
}


def exclusion_ledger(classified: DataFrame, most: int = 20) -> DataFrame:
    """(exclusion_kind, files, sample, sentence): what was left out, with its first paths and what the kind means."""
    out = classified.where("exclusion_kind is not null").select("exclusion_kind", "path")
    first = topk.per_key(out, ["exclusion_kind"], most, F.asc("path")).groupBy("exclusion_kind").agg(F.array_sort(F.collect_list("path")).alias("sample"))
    said = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    counts = out.groupBy("exclusion_kind").agg(F.count("*").alias("files"))
    return counts.join(first, "exclusion_kind").withColumn("sentence", F.replace(F.coalesce(said[F.col("exclusion_kind")], F.concat(F.lit("%d "), "exclusion_kind")), F.lit("%d"), F.col("files").cast("string")))


def never_read(path: str) -> bool:
    """Whether any part of a path has a name that may hold secrets."""
    return any(re.search(SENSITIVE, p) for p in path.lower().split("/"))


def known_kind(path: str) -> bool:
    """Whether a path has an extension of code or prose, as ``paths.kind_of`` has it."""
    stem, dot, extension = path.rpartition("/")[2].rpartition(".")
    return bool(stem) and (extension.lower() in EXTENSIONS or extension.lower() in DOC_EXTENSIONS)


def read_file(root: str, relative: str) -> tuple[str | None, str | None, str | None]:
    """(text, digest, problem) of a file; problem: binary-content, not-utf-8 or unreadable; never a lossy text.

    It is opened only if it still is where the listing found it, without a link on the way.
    """
    inside = os.path.realpath(root)
    place = os.path.join(inside, relative)
    try:
        if os.path.realpath(place) != place:
            return None, None, "unreadable"
        with open(os.open(place, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
            raw = f.read(LIMITS["file_bytes"] + 1)
    except OSError:
        return None, None, "unreadable"
    digest = hashlib.sha256(raw).hexdigest()
    if b"\0" in raw[:1024]:
        return None, digest, "binary-content"
    try:
        return raw.decode("utf-8-sig"), digest, None
    except UnicodeDecodeError:
        return None, digest, "not-utf-8"


def read_texts(classified: DataFrame, root: str) -> DataFrame:
    """The corpus's files with text, digest and problem, as ``read_file`` has them; a link's are those of what it leads to."""
    columns = ["path", "kind", "language", "module", "role", "size"]
    chosen = classified.where("exclusion_kind is null").select(*columns, F.coalesce("target", "path").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                read = [read_file(root, p) for p in part.column(len(columns)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([r[i] for r in read], pa.string()) for i in range(3))], names=[*columns, "text", "sha", "problem"])

    return chosen.mapInArrow(run, "path string, kind string, language string, module string, role string, size long, text string, sha string, problem string")


def strip_block(text: F.Column, begin: str, end: str) -> F.Column:
    """A text without its one block between two marker lines; texts with more or fewer markers stay whole."""
    n = lambda m: (F.length(text) - F.length(F.replace(text, F.lit(m), F.lit("")))) / len(m)
    cut = F.concat(F.substring_index(text, begin, 1), F.substring_index(text, end, -1))
    return F.when((n(begin) == 1) & (n(end) == 1) & (F.instr(text, begin) < F.instr(text, end)), cut).otherwise(text)


def monorepo(classified: DataFrame) -> DataFrame:
    """One row: package roots below the top, code files, and whether this looks like several projects."""
    rows = classified.withColumn("name", paths.name_of(F.col("path")))
    got = rows.agg(F.countDistinct(F.when(F.col("name").isin(MANIFESTS) & (F.col("module") != "."), F.col("module"))).alias("roots"), F.sum((F.col("kind") == "code").cast("long")).alias("code_files"))
    return got.withColumn("monorepo", (F.col("roots") >= 3) | (F.col("code_files") >= 5000))


def declared_workspaces(classified: DataFrame, root: str) -> list[str]:
    """The root's manifests that declare several projects; excluded, oversized and escaping ones aren't opened."""
    names = [*WORKSPACES, "Cargo.toml", "package.json"]
    rows = classified.where(F.col("path").isin(names)).select("path", "exclusion_kind").collect()
    found = []
    for path in sorted(r["path"] for r in rows if r["exclusion_kind"] in (None, "unsupported", "corpus-budget")):
        if path in WORKSPACES:
            found.append(path)
            continue
        full = os.path.join(os.path.realpath(root), path)
        try:
            if os.path.realpath(full) != full:  # a link is no manifest
                continue
            with open(full, "rb") as f:
                raw = f.read(LIMITS["file_bytes"] + 1)
            if len(raw) > LIMITS["file_bytes"]:
                continue
            if path == "Cargo.toml":
                declares = b"[workspace]" in raw
            else:
                doc = json.loads(raw)
                declares = isinstance(doc, dict) and "workspaces" in doc
        except (OSError, ValueError, RecursionError):
            continue
        if declares:
            found.append(path)
    return found


__all__ = ["Config", "DOC_EXTENSIONS", "EXTENSIONS", "classify", "declared_workspaces", "exclusion_ledger", "list_files", "monorepo", "read_texts", "strip_block"]
