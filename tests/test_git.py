"""Git state per file."""

import os
import subprocess

import pytest
from lexiloom.sources import git


def run(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    for name in ("kept.py", "changed.py", "old name.py", "gone.py", "since.py", "é\nline.py"):
        (root / name).write_text(f"{name} = 1\n" * 5)
    (root / ".gitignore").write_text("ignored.py\n")
    run(root, "init", "-q")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "first")
    return root


def test_states_by_file_with_renames_and_odd_names(spark, repo):
    first = git.git_stamp(str(repo))
    assert first["dirty"] is False and len(first["head"]) == 40
    (repo / "since.py").write_text("x = 2\n")
    run(repo, "commit", "-qam", "second")
    (repo / "changed.py").write_text("y = 2\n")
    run(repo, "mv", "old name.py", "new\tname.py")
    os.remove(repo / "gone.py")
    (repo / "fresh.py").write_text("z\n")
    (repo / "ignored.py").write_text("z\n")
    (repo / "é\nline.py").write_text("w\n")
    got = {r["path"]: (r["state"], r["origin"]) for r in git.file_states(spark, str(repo)).collect()}
    assert got == {"changed.py": ("modified", None), "new\tname.py": ("renamed", "old name.py"), "gone.py": ("deleted", None), "fresh.py": ("untracked", None), "é\nline.py": ("modified", None)}
    assert {p: git.path_state(str(repo), p) for p in ("kept.py", "changed.py", "fresh.py", "ignored.py")} == {"kept.py": "committed", "changed.py": "modified", "fresh.py": "untracked", "ignored.py": "ignored"}
    sources = ["./kept.py", "kept.py", "changed.py", "old name.py", "new\tname.py", "gone.py", "since.py", "fresh.py", "é\nline.py", "nowhere.py", "", None]
    nodes = spark.createDataFrame([(s,) for s in sources], "source_file string")
    fresh = {r["source_file"]: (r["nodes"], r["state"]) for r in git.file_freshness(nodes, str(repo), first["head"]).collect()}
    assert fresh == {"kept.py": (2, "current"), **{p: (1, "stale") for p in ("changed.py", "old name.py", "new\tname.py", "gone.py", "since.py", "fresh.py", "é\nline.py")}, "nowhere.py": (1, "unknown")}
    head = git.git_stamp(str(repo))["head"]
    assert {r["source_file"]: r["state"] for r in git.file_freshness(nodes, str(repo), head[:10]).collect()}["since.py"] == "current"
    for bad in (None, "--output=x", "0" * 40, "abc"):
        assert {r["state"] for r in git.file_freshness(nodes, str(repo), bad).collect()} == {"unverified"}


def test_outside_of_git(spark, tmp_path):
    assert git.git_stamp(str(tmp_path)) == {"head": None, "dirty": None} and git.path_state(str(tmp_path), "x") is None and git.file_states(spark, str(tmp_path)) is None


def test_nothing_the_repository_names_is_run(spark, repo):
    for key in ("clean", "smudge", "process"):
        run(repo, "config", f"filter.own.{key}", f"touch {repo}/ran-{key}")
    run(repo, "config", "core.fsmonitor", f"touch {repo}/ran-monitor")
    (repo / ".gitattributes").write_text("*.py filter=own\n")
    (repo / "changed.py").write_text("y = 2\n")
    git.file_states(spark, str(repo))
    git.git_stamp(str(repo))
    assert not [n for n in os.listdir(repo) if n.startswith("ran-")]


def test_records():
    assert git.status_records(b"R  new\0old\0?? a b\0 M c\0!! d/\0UU e\0 D f\0") == [("new", "renamed", "old"), ("a b", "untracked", None), ("c", "modified", None), ("d/", "ignored", None), ("e", "conflicted", None), ("f", "deleted", None)]
    assert git.status_records(b"") == []
