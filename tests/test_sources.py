"""Listing, links, exclusions and the corpus's budget."""

import os
import random

import pytest
from lexiloom.operators import topk
from lexiloom.plans import evidence
from lexiloom.sources import repository
from pyspark.sql import functions as F


def write(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def test_links_get_the_verdict_of_what_they_lead_to(spark, tmp_path):
    root = write(tmp_path / "in", {
        ".env": "TOPSECRETTOKEN=1", "vendor/v.py": "vendored_word = 1", "GLOSSARY.md": "glossaryword", "src/real.py": "plain_word = 1", "tests/t.py": "tested_word = 1", ".hid/h.py": "hidden_word = 1",
        "skip/s.py": "skipped_word = 1", "keys-secret/k.py": "folder_secret = 1", "lexiloom-out/o.md": "outword", "b/big.py": "y" * 2_000_001, "dir/d.py": "dir_word = 1",
    })
    write(tmp_path, {"outside.py": "outside_word = 1"})
    targets = {
        "notes.md": (".env", "sensitive"), "a.py": ("vendor/v.py", "symlink-excluded"), "x.md": ("GLOSSARY.md", "symlink-excluded"), "ok.py": ("src/real.py", None), "role.py": ("tests/t.py", None), "h.py": (".hid/h.py", "symlink-excluded"),
        "s.py": ("skip/s.py", "symlink-excluded"), "k.py": ("keys-secret/k.py", "sensitive"), "o.md": ("lexiloom-out/o.md", "symlink-excluded"), "big.py": ("b/big.py", "too-large"), "gone.py": ("src/none.py", "unreadable"),
        "out.py": ("../outside.py", "symlink-escapes"), "my-secret.py": ("src/real.py", "sensitive"), "folder": ("dir", "symlink-directory"), "away": ("../..", "symlink-escapes"), "data.bin": ("../outside.py", "unsupported"), ".dot.py": ("../outside.py", "hidden"),
    }
    for name, (target, _) in targets.items():
        os.symlink(target, tmp_path / "in" / name)
    config = repository.Config.parse({"schema_version": 1, "ignore_paths": ["skip"]})
    rows = {r["path"]: r for r in repository.classify(spark, root, config).collect()}
    assert {n: rows[n]["exclusion_kind"] for n in targets} == {n: why for n, (_, why) in targets.items()}
    assert rows["role.py"]["role"] == "test" and rows["ok.py"]["role"] == "production" and rows["ok.py"]["target"] == "src/real.py"
    e = evidence.scan(spark, root, config)
    names = {r["name"] for r in e.ident_occ.collect()} | {r["term"] for r in e.doc_occ.collect()}
    assert names == {"plain_word", "dir_word"}
    assert not any("TOPSECRET" in str(v) for df in (e.classified, e.files, e.ident_occ, e.tok_occ, e.doc_occ, e.resolved) for r in df.collect() for v in r)
    ledger = {r["exclusion_kind"]: r for r in repository.exclusion_ledger(e.classified).collect()}
    assert ledger["symlink-excluded"]["files"] == 5 and ledger["symlink-excluded"]["sample"][0] == "a.py" and ledger["symlink-excluded"]["sentence"].startswith("5 link(s)")
    assert set(ledger) <= set(repository.SENTENCES)


def test_a_link_changed_after_the_listing_is_not_followed(spark, tmp_path):
    root = write(tmp_path / "in", {"a.py": "one_word = 1", "b.py": "two_word = 1"})
    write(tmp_path, {"out.py": "outside_word = 1"})
    listed = repository.classify(spark, root).cache()
    listed.count()
    os.remove(tmp_path / "in" / "a.py")
    os.symlink(tmp_path / "out.py", tmp_path / "in" / "a.py")
    got = {r["path"]: (r["text"], r["problem"]) for r in repository.read_texts(listed, root).collect()}
    assert got == {"a.py": (None, "unreadable"), "b.py": ("two_word = 1", None)}


def test_sensitive_comes_before_ignored_and_hidden(tmp_path):
    root = write(tmp_path, {"skip/a.py": "x", ".secrets/b.py": "x", "ignored-secret/c.py": "x"})
    config = repository.Config.parse({"schema_version": 1, "ignore_paths": ["skip", "ignored-secret"]})
    assert {e.path: e.why for e in repository.list_files(root, config)} == {"skip": "ignored", ".secrets": "sensitive", "ignored-secret": "sensitive"}


def greedy(costs, budget):
    out = []
    for c in costs:
        out.append(c is not None and 0 <= c <= budget)
        budget -= c if out[-1] else 0
    return out


@pytest.mark.parametrize("seed", range(6))
def test_greedy_budget_is_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    n, budget = rng.choice([1, 30, 400]), rng.choice([0, 7, 100, 1000, 10**9])
    costs = [rng.choice([None, -1, 0, 1, budget // 2, budget // 2 + 1, budget, budget + 1, rng.randint(0, budget + 1), rng.randint(0, budget // 10 + 1)]) for _ in range(n)]
    rows = list(enumerate(costs))
    rng.shuffle(rows)
    got = topk.greedy_budget(spark.createDataFrame(rows, "i long, size long"), F.col("size"), budget, F.asc("i"))
    assert [r["admitted"] for r in got.orderBy("i").collect()] == greedy(costs, budget)


def test_corpus_budget_lets_smaller_files_in(spark, tmp_path, monkeypatch):
    root = write(tmp_path, {"a.py": "x" * 60, "b.py": "x" * 50, "c.py": "x" * 30, "d.py": "x" * 20, "e.py": "x"})
    monkeypatch.setitem(repository.LIMITS, "corpus_bytes", 100)
    monkeypatch.setitem(repository.LIMITS, "source_files", 2)
    got = {r["path"]: r["exclusion_kind"] for r in repository.classify(spark, root).collect()}
    assert {p for p, why in got.items() if why is None} == {"a.py", "c.py"} and got["b.py"] == got["d.py"] == "corpus-budget"


def test_the_data_source_lists_the_same_rows(spark, tmp_path, monkeypatch):
    from lexiloom.sources import datasource

    root = write(tmp_path / "in", {f"m{i}/s{j}/f{k}.py": f"word_{i}{j}{k} = 1" for i in range(4) for j in range(3) for k in range(2)} | {"a.py": "top_word = 1", "vendor/v.py": "x", ".env": "S=1", "m1/.hid/h.py": "x", "m2/s0/bad.py": b"\xff", "m3/keys-secret/k.py": "x"})
    os.symlink("../.env", tmp_path / "in" / "m0" / "n.md")
    os.symlink("../a.py", tmp_path / "in" / "m0" / "ok.py")
    datasource.register(spark)
    load = lambda **o: spark.read.format("repository").options(**o).load(root)
    listed = repository.list_files(root)
    for parts in (1, 5, 64):
        rows = load(partitions=parts).orderBy("walk_order").collect()
        assert [tuple(r)[:5] for r in rows] == [tuple(e) for e in listed]
    text = {r["path"]: (r["text"], r["problem"]) for r in rows if r["text"] or r["problem"]}
    assert text["a.py"] == text["m0/ok.py"] == ("top_word = 1", None) and text["m2/s0/bad.py"] == (None, "not-utf-8") and "m0/n.md" not in text and ".env" not in text
    judged = {r["path"]: r["exclusion_kind"] for r in repository.judge(load(texts="false"), repository.Config()).collect()}
    assert judged == {r["path"]: r["exclusion_kind"] for r in repository.classify(spark, root).collect()}
    got = load().where(F.col("path").startswith("m1/s2/")).select("path").collect()
    assert sorted(r["path"] for r in got) == ["m1/s2/f0.py", "m1/s2/f1.py"]
    reader, opened, scan = datasource.RepositoryReader({"path": root}), [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, root)) or scan(p))
    list(reader.pushFilters([datasource.StringStartsWith(("path",), "m1/s2/")]))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert set(opened) == {".", "m1", "m1/s2"} and {r[0] for r in rows} >= {"m1/s2/f0.py", "m1/s2/f1.py"}


def test_unread_files_leave_the_corpus_and_absence_is_withheld(spark, tmp_path):
    root = write(tmp_path, {"a.py": "widget_count = 1\nwidget_size = 2", "bad.py": b"\xff\xfe"})
    glossary = {"schema_version": 1, "concepts": [{"id": "gone", "term": "Gone", "definition": "d", "status": "canonical"}]}
    e = evidence.scan(spark, root)
    assert {r["path"]: r["exclusion_kind"] for r in e.classified.collect()} == {"a.py": None, "bad.py": "unreadable"}
    out = evidence.findings(spark, e, glossary, "drift")
    assert out["findings"] == [] and out["withheld"] == {"canonical-fading": 1} and not out["complete"]
    section = {s["kind"]: s for s in out["sections"]}["canonical-fading"]
    assert section["total"] == 0 and not section["exact"] and any("withheld" in r for r in section["reasons"])
    os.remove(tmp_path / "bad.py")
    out = evidence.findings(spark, evidence.scan(spark, root), glossary, "validate")
    fading = next(f for f in out["findings"] if f["kind"] == "canonical-fading")
    assert out["withheld"] == {} and fading["evidence"]["count"] == 0 and fading["summary"] == "the canonical 'Gone' isn't used in code"
    assert {f["kind"] for f in out["findings"]} == {"canonical-fading", "orphaned-concept"}


def test_sweep_deletes_what_was_cut(spark):
    from lexiloom.sources import shared

    shared.sweep(spark)
    kept = shared.cut(spark.range(5))
    path = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(path) and shared.sweep(spark) == 1 and not os.path.exists(path) and shared.sweep(spark) == 0
