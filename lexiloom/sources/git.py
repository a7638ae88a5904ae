"""The Git state of a repository and of its files, by a runner that executes nothing the repository names."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = re.compile(r"[0-9a-fA-F]{7,64}")
#: How files of a graph stand to the commit it was made at.
CURRENT, STALE, UNKNOWN, UNVERIFIED = "current", "stale", "unknown", "unverified"


class Git:
    """Hooks, filters and monitors are off, the locale is fixed, and a command has 30 seconds."""

    def __init__(self, root: str):
        self.safe = ["git", "-C", root, "-c", "core.hooksPath=/dev/null", "-c", "core.fsmonitor=false", "-c", "core.quotePath=false"]
        self.env = {"PATH": os.environ.get("PATH", ""), "GIT_CONFIG_NOSYSTEM": "1", "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}
        # A driver that the repository's own settings name would run under status; each is emptied first.
        named = self.ask("config", "--name-only", "--get-regexp", r"^filter\..*\.(clean|smudge|process|required)$") or b""
        for driver in sorted({line.rpartition(".")[0] for line in named.decode(errors="replace").splitlines() if line}):
            self.safe += [x for key, value in (("clean", ""), ("smudge", ""), ("process", ""), ("required", "false")) for x in ("-c", f"{driver}.{key}={value}")]

    def ask(self, *args: str) -> bytes | None:
        """What a command prints; null if it fails, takes too long or there is no Git."""
        try:
            r = subprocess.run([*self.safe, *args], capture_output=True, timeout=30, env=self.env)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return r.stdout if r.returncode == 0 else None

    def head(self) -> str | None:
        out = self.ask("rev-parse", "HEAD")
        return out.decode().strip() if out else None


def git_stamp(root: str) -> dict:
    """{head, dirty}; null where Git can't tell."""
    git = Git(root)
    head, status = git.head(), git.ask("status", "--porcelain")
    return {"head": head, "dirty": bool(status) if status is not None else None}


def status_records(raw: bytes) -> list[tuple[str, str, str | None]]:
    """(path, state, origin) of NUL-separated status records; state: modified, deleted, renamed, copied, untracked, ignored or conflicted.

    A rename's or copy's origin follows in a record of its own. Names may hold
    any character; bytes that aren't UTF-8 are replaced.
    """
    fields, out = iter(raw.decode(errors="replace").split("\0")), []
    for record in fields:
        if len(record) < 4:
            continue
        code, path = record[:2], record[3:]
        origin = next(fields, None) if "R" in code or "C" in code else None
        if code in ("??", "!!"):
            state = "untracked" if code == "??" else "ignored"
        elif "U" in code or code in ("AA", "DD"):
            state = "conflicted"
        else:
            state = "renamed" if "R" in code else "copied" if "C" in code else "deleted" if "D" in code else "modified"
        out.append((path, state, origin))
    return out


def path_state(root: str, relative: str) -> str | None:
    """committed, modified, untracked or ignored, for one path; null where Git can't tell."""
    raw = Git(root).ask("status", "--porcelain=v1", "-z", "--ignored", "--untracked-files=all", "--no-renames", "--", relative)
    if raw is None:
        return None
    records = status_records(raw)
    return "committed" if not records else records[0][1] if records[0][1] in ("untracked", "ignored") else "modified"


def file_states(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, state, origin) of every path that differs from HEAD or isn't tracked; null where Git can't tell."""
    raw = Git(root).ask("status", "--porcelain=v1", "-z", "--untracked-files=all")
    return None if raw is None else spark.createDataFrame(status_records(raw), "path string, state string, origin string")


def tidy(path: Column) -> Column:
    """A repository path without empty and . segments."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), "/")


def file_freshness(nodes: DataFrame, root: str, commit: str | None) -> DataFrame:
    """(source_file, nodes, state): how each file of a graph's ``nodes(source_file)`` stands to the commit the graph was made at.

    current: tracked, and neither changed since that commit nor in the work
    tree; stale: changed, renamed, deleted, new or untracked; unknown: no such
    file is known; unverified: no commit, or Git can't tell. Nodes without a file
    are left out.
    """
    spark, git = nodes.sparkSession, Git(root)
    files = nodes.where("source_file is not null and source_file != ''").groupBy(tidy(F.col("source_file")).alias("source_file")).agg(F.count("*").alias("nodes"))
    known = commit is not None and COMMIT.fullmatch(commit) and git.ask("rev-parse", "--verify", "--quiet", f"{commit}^{{commit}}")
    changed = git.ask("diff", "--name-only", "-z", "--no-renames", "--no-ext-diff", "--no-textconv", commit, "HEAD", "--") if known else None
    tracked, states = git.ask("ls-files", "-z"), file_states(spark, root)
    if changed is None or tracked is None or states is None:
        return files.withColumn("state", F.lit(UNVERIFIED))
    names = lambda raw: spark.createDataFrame([(p,) for p in raw.decode(errors="replace").split("\0") if p], "path string")
    moved = states.select("path").union(states.where("origin is not null").select("origin")).union(names(changed)).distinct()
    met = files.join(moved.select(F.col("path").alias("source_file"), F.lit(True).alias("moved")), "source_file", "left").join(names(tracked).distinct().select(F.col("path").alias("source_file"), F.lit(True).alias("tracked")), "source_file", "left")
    return met.select("source_file", "nodes", F.when(F.col("moved"), STALE).when(F.col("tracked"), CURRENT).otherwise(UNKNOWN).alias("state"))
