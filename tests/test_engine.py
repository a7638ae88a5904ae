"""Operators on small repositories and literal tables."""

import io
import json
import os

import pytest
from lexiloom import cli
from lexiloom.operators import graph, imports, matching, naming, terminology, topk, vocabulary
from lexiloom.plans import checks, context, evidence, glossaries, report
from lexiloom.sources import cache as caches
from lexiloom.sources import documents, graphs, repository
from lexiloom.sources.cache import ExtractionCache
from lexiloom.streaming import incremental
from pyspark.sql import functions as F


def write(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text) if isinstance(text, bytes) else p.write_text(text, encoding="utf-8")
    return str(root)


def names(*own):
    return "\n".join(f"{n} = int" for n in own) + "\n"


CALIBRATION = {
    "runs.py": names("run_record", "run_scheduler", "start_run", "run_record_id"),
    "executions.py": names("execution_record", "execution_scheduler", "start_execution", "execution_record_id"),
    "gateway.py": names("gateway_client", "gateway_request", "gateway_total", "charge_request", "charge_total"),
    "auth/session.py": names("session_login", "session_cookie"),
    "db/session.py": names("session_transaction", "session_commit"),
    "ml/session.py": names("session_inference", "session_model"),
}
GLOSSARY = {"schema_version": 1, "concepts": [{"id": i, "term": t, "definition": "d", "status": "canonical", "aliases": a} for i, t, a in (("run", "Run", []), ("gateway", "Gateway", [{"term": "charge", "status": "discouraged"}]), ("workspace", "Workspace", []), ("session", "Session", []))]}


@pytest.fixture(scope="module")
def calibration(spark, tmp_path_factory):
    return evidence.scan(spark, write(tmp_path_factory.mktemp("cal"), CALIBRATION))


def test_synonyms_of_the_calibration_corpus(calibration):
    got = terminology.synonym_candidates(calibration.tok_occ, calibration.token_counts()).collect()
    row = next(r for r in got if {r["a"], r["b"]} == {"run", "execution"})
    assert (row["similarity"], row["file_overlap_rate"], row["shared_patterns"]) == (1.0, 0.0, 4)
    assert set(row["contexts"].split()) == {"record", "id", "scheduler", "start"}


def test_dispersion_of_the_calibration_corpus(calibration):
    got = {r["term"]: r for r in terminology.context_dispersion(calibration.tok_occ, calibration.token_counts()).collect()}
    assert (got["session"]["dispersion"], got["session"]["modules"], got["session"]["divergent"]) == (1.0, 3, True)


def test_drift_of_the_calibration_corpus(spark, calibration):
    got = {(r["kind"], r["subject"]): r for r in evidence.drift(spark, calibration, GLOSSARY).collect()}
    assert set(got) == {("parallel-term", "run:execution"), ("watched-term-in-use", "gateway:charge"), ("canonical-fading", "workspace:Workspace"), ("canonical-overloaded", "session:Session")}
    assert got["watched-term-in-use", "gateway:charge"]["value"] == 2
    assert all((r["signal_strength"] is None) != (r["certainty"] is None) for r in got.values())


def test_scan_rules(spark, tmp_path):
    root = write(tmp_path, {"a.py": "x_value = 1", "_b.py": "under_score = 1", ".hidden.py": "z", ".env": "S=1", "secrets.yaml": "k", "cert.pem": "k", "GLOSSARY.md": "word", "lexiloom-out/x.md": "echo", "node_modules/m.js": "v", "bin.py": b"\0\1", "bad.py": b"\xff\xfe a", "n.md": "prose words here", "big.py": "y" * 2_000_001, "skip/s.py": "q_r = 1", "img.png": "p"})
    config = repository.Config.parse({"schema_version": 1, "ignore_paths": ["skip"], "path_roles": {"test": ["n.md"]}})
    c = {r["path"]: r["exclusion_kind"] for r in repository.classify(spark, root, config).collect()}
    assert {p for p, why in c.items() if why is None} == {"a.py", "_b.py", "bin.py", "bad.py", "n.md"}
    assert (c[".env"], c["node_modules"], c["big.py"], c["skip"], c["GLOSSARY.md"]) == ("sensitive", "vendored", "too-large", "ignored", "own-output")
    e = evidence.scan(spark, root, config)
    assert {r["path"]: r["problem"] for r in e.files.where("problem is not null").collect()} == {"bin.py": "binary-content", "bad.py": "not-utf-8"}
    assert {r["name"] for r in e.ident_occ.collect()} == {"x_value", "under_score"} and e.doc_occ.count() == 0
    with pytest.raises(ValueError):
        repository.Config.parse({"schema_version": 1, "ignore_paths": ["a/*"]})
    assert repository.exclusion_ledger(repository.classify(spark, root)).count() > 4


def test_import_graph(spark):
    files = spark.createDataFrame(
        [("lib/util.py", "python", ""), ("lib/core.js", "javascript", ""), ("app/main.py", "python", "import lib.util\nfrom lib.util import x\nimport yojson_like\nfrom . import sibling\n"), ("app/sibling.py", "python", ""),
         ("web/index.js", "javascript", "import a from '../lib/core'\nconst _ = require('lodash')"), ("src/net.rs", "rust", "use crate::wire::Frame;\nuse super::other;\n"), ("src/wire/mod.rs", "rust", ""), ("m.go", "go", 'import (\n  "fmt"\n  x "lib/util"\n)'), ("h.c", "c", '#include "helpers.h"\n'), ("inc/helpers.h", "c", "")],
        "path string, language string, text string",
    )
    r = imports.resolve(imports.import_specs(files), files)
    edges = {(x["src"], x["dst"]): x["uses"] for x in imports.internal_edges(r).collect()}
    assert edges[("app", "lib")] == 2 and edges[("web", "lib")] == 1 and edges[("src", "src/wire")] == 1 and edges[(".", "inc")] == 1 and edges[(".", "lib")] == 1
    assert {x["name"] for x in imports.external_tally(r).collect()} >= {"lodash", "yojson_like", "fmt"}


def test_register_example(spark):
    occ = spark.createDataFrame([(n, "a.py", ".", "python", 1) for n in ("PaymentService", "BillingService", "OrderService", "payment_total", "billing_total")], vocabulary.IDENT_OCC)
    reg = terminology.register(vocabulary.token_occurrences(occ), spark.createDataFrame([], "term string, uses long, files long"))
    assert {r["style"]: r["pct"] for r in terminology.style_shares(reg).collect()} == {"PascalCase": 60.0, "snake_case": 40.0}
    assert [(r["token"], r["spellings"]) for r in terminology.affixes(reg, "suffix").collect()] == [("service", 3), ("total", 2)]


def test_compounds_are_contiguous(spark):
    occ = spark.createDataFrame([("create_payment_request", "a", ".", "python", 5), ("payment_request_payment_request", "a", ".", "python", 2), ("payment_late_request", "a", ".", "python", 9)], vocabulary.IDENT_OCC)
    terms = matching.term_tokens(spark.createDataFrame([("c", "Payment Request", "canonical")], "concept string, term string, status string"))
    assert matching.occurrence_totals(terms, matching.occurrences(terms, vocabulary.token_occurrences(occ))).head()["uses"] == 7


def test_graph_parsing(spark):
    doc = {"nodes": [{"id": 0, "label": "old"}, {"id": 0, "label": "PaymentGateway", "source_file": "a.py", "community": 7, "community_name": "Payments"}, {"name": "b", "community": 7, "source_file": "x/../GLOSSARY.md"}, {"id": "c"}], "links": [{"source": 0, "target": "b"}, {"source": "c", "target": 0}, {"source": "c"}], "communities": [{"id": 0, "nodes": ["0", "0", "c"], "cohesion": 0.5}, {"id": 1, "nodes": [], "cohesion": True}]}
    texts = spark.createDataFrame([(json.dumps(doc),)], "json string")
    nodes, links, groups = graph.parse_graph(texts)
    assert {r["id"]: r["label"] for r in nodes.collect()} == {"0": "PaymentGateway", "b": "b", "c": "c"}
    assert {(r["source"], r["target"]) for r in graph.visible_links(links, nodes).collect()} == {("c", "0")}
    assert {r["id"]: r["cohesion"] for r in groups.collect()} == {"0": 0.5, "1": None}
    assert {(r["group"], r["id"]) for r in graph.memberships(nodes, groups).collect()} == {("0", "0"), ("0", "c")}
    assert graphs.cut_graph(json.dumps(doc)).refs == 12
    assert graph.group_labels(nodes).head()["label"] == "Payments"


def test_ledgers_and_budget(spark):
    df = spark.createDataFrame([(i, 10) for i in range(100)], "i long, c long")
    top, led = topk.top_k_with_ledger(df, 5, F.asc("i"))
    assert top.count() == 5 and led["dropped_items"] == 95 and not led["complete"] and led["total_items_exact"]
    assert topk.ledger(3, 3)["complete"] and not topk.ledger(3, 3, reasons=["x"])["complete"]
    assert topk.within_budget(df, F.col("c"), 305, F.asc("i")).count() == 30


def test_glossary_rules():
    assert glossaries.validate(GLOSSARY) == [] and glossaries.validate(glossaries.STANDING) == []
    bad = {"schema_version": 1, "concepts": [{"id": "a", "term": "Run", "definition": "d", "status": "x", "extra": 1}, {"id": "a", "term": "Run", "definition": "", "status": "canonical"}, {"id": "b", "term": "RUN", "definition": "d", "status": "canonical", "scope": {"path_prefixes": ["/abs"]}}]}
    said = "\n".join(glossaries.validate(bad))
    for part in ("unknown field extra", "status", "definition", "repeated", "scope", "run: owned by a and b"):
        assert part in said
    scoped = {"schema_version": 1, "concepts": [{"id": i, "term": "Session", "definition": "d", "status": "canonical", "scope": {"path_prefixes": [i]}} for i in ("auth", "db")]}
    assert glossaries.validate(scoped) == []


def test_documents(tmp_path):
    p = tmp_path / "d.json"
    documents.write_json(str(p), {"b": 1, "a": "é"})
    assert documents.read_json(str(p)) == ("ok", {"b": 1, "a": "é"})
    assert documents.read_json(str(tmp_path / "none")) == ("absent", None)
    p.write_text("﻿{}", encoding="utf-8")
    assert documents.read_json(str(p)) == ("ok", {})
    p.write_text('{"a": NaN}')
    assert documents.read_json(str(p))[0] == "malformed" and documents.read_json(str(p), 3)[0] == "oversized"
    assert evidence.brief(GLOSSARY, 60).endswith("of 4 terms)\n") and evidence.shorten("äöü", 5) == "ä…"


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path.parent / f"{tmp_path.name}-cache"))
    root = write(tmp_path, CALIBRATION | {"doc.md": "run gateway session"})
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(GLOSSARY)))
    assert cli.main(["save", root]) == 0 and cli.main(["show", root]) == 0 and cli.main(["brief", root]) == 0
    assert cli.main(["analyze", root]) == 0 and (tmp_path / "lexiloom-out/evidence.json").exists()
    first = (tmp_path / "lexiloom-out/evidence.json").read_bytes()
    assert cli.main(["analyze", root]) == 0 and (tmp_path / "lexiloom-out/evidence.json").read_bytes() == first
    assert cli.main(["drift", root]) == 1 and "parallel-term" in capsys.readouterr().out
    assert cli.main(["analyze", str(tmp_path / "none")]) == 2


def test_module_scores_and_strip(spark):
    edges = spark.createDataFrame([("a", "lib", 3), ("b", "lib", 1), ("a", ".", 9)], "src string, dst string, uses long")
    got = naming.module_scores(edges, spark.createDataFrame([("lib", 4)], "module string, code_files long"), spark.createDataFrame([("lib", 2)], "term string, uses long")).collect()
    assert [(r["module"], r["importers"]) for r in got] == [("lib", 2)] and abs(got[0]["score"] - 13.03) < 0.02
    df = spark.createDataFrame([("x<B>y<E>z",), ("x<B>y",), ("<E>a<B>",)], "t string")
    assert [r[0] for r in df.select(repository.strip_block(F.col("t"), "<B>", "<E>")).collect()] == ["xz", "x<B>y", "<E>a<B>"]


def test_cache_and_stream(spark, tmp_path):
    cache = ExtractionCache(spark, str(tmp_path / "none"), "path string, sha string")
    assert cache.read().count() == 0
    spark.createDataFrame([("a", "run the run"), ("b", "run fast")], "path string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    q = incremental.append_occurrences(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("term").agg(F.sum("n")).collect()
    assert {r[0]: r[1] for r in got} == {"run": 3, "fast": 1}
    assert incremental.term_counts(stream).isStreaming


def test_standalone_without_the_optional_part(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 59 and not any(n.startswith('op1') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_precision_recall(spark):
    f = spark.createDataFrame([("k", "a"), ("k", "b")], "kind string, subject string")
    e = spark.createDataFrame([("k", "a"), ("k", "c")], "kind string, subject string")
    assert tuple(checks.precision_recall(f, e).head()) == (1, 1, 1, 0.5, 0.5)


def test_extraction_is_reused(spark, tmp_path):
    root = write(tmp_path / "repo", CALIBRATION | {"doc.md": "run gateway session", "empty.py": ""})
    at = caches.location(root, str(tmp_path / "home"))
    cache = ExtractionCache(spark, at)
    rows = lambda e: (sorted(map(tuple, e.ident_occ.collect())), sorted(map(tuple, e.doc_occ.collect())))
    plain = rows(evidence.scan(spark, root))
    assert rows(evidence.scan(spark, root, cache=cache)) == plain
    assert cache.read().count() == 8  # an empty file is known as well
    assert rows(evidence.scan(spark, root, cache=cache)) == plain and cache.read().count() == 8
    (tmp_path / "repo/runs.py").write_text(names("other_name"))
    changed = rows(evidence.scan(spark, root, cache=cache))
    assert changed == rows(evidence.scan(spark, root)) != plain and cache.read().count() == 9
    (tmp_path / "home/mine").write_text("kept")
    assert caches.clear(at) > 0 and caches.clear(at) == 0 and not (tmp_path / "home" / at.split("/")[-2]).exists()
    assert (tmp_path / "home/mine").exists() and cache.read().count() == 0
    assert caches.location(root, root + "/inside") is None


def test_unreadable_cache_is_a_miss(spark, tmp_path):
    at = tmp_path / "c"
    write(at, {"part-0.parquet": b"no parquet"})
    assert ExtractionCache(spark, str(at)).read().count() == 0


def test_managed_context(tmp_path):
    host = tmp_path / "AGENTS.md"
    assert context.status(context.read_host(str(host)), GLOSSARY) == "absent"
    assert context.sync(str(host), GLOSSARY) == "absent" and context.sync(str(host), GLOSSARY) == "current"
    host.write_text("Mine above.")
    host.chmod(0o600)
    assert context.sync(str(host), GLOSSARY) == "absent"
    text = host.read_text()
    assert text.startswith("Mine above.\n\n<!-- lexiloom:begin") and host.stat().st_mode & 0o777 == 0o600
    host.write_text(text + "Mine below.\n")
    less = {"schema_version": 1, "concepts": GLOSSARY["concepts"][:1]}
    assert context.sync(str(host), less) == "stale"
    assert host.read_text() == "Mine above.\n\n" + context.render(less) + "Mine below.\n"
    host.write_text(host.read_text().replace("Run", "Ran"))
    edited = host.read_text()
    assert context.sync(str(host), less) == "edited" and host.read_text() == edited
    assert context.sync(str(host), less, repair=True) == "edited" and context.status(host.read_text(), less) == "current"
    host.write_text(edited + edited)
    assert context.sync(str(host), less, repair=True) == "uninspectable" and host.read_text() == edited + edited
    (tmp_path / "CLAUDE.md").symlink_to(host)
    assert context.read_host(str(tmp_path / "CLAUDE.md")) is None


def test_managed_block_is_no_evidence(spark, tmp_path):
    block = "mine above\n" + context.render(GLOSSARY)
    e = evidence.scan(spark, write(tmp_path, {"docs/AGENTS.md": block, "docs/other.md": "<!-- lexiloom:begin x --> workspace <!-- lexiloom:end -->"}))
    got = {(r["path"], r["term"]) for r in e.doc_occ.collect()}
    assert ("docs/AGENTS.md", "mine") in got and ("docs/AGENTS.md", "workspace") not in got and ("docs/other.md", "workspace") in got


def test_structure_and_markdown_of_a_repository(spark, tmp_path):
    nodes = [{"id": f"n{i}", "label": f"run_record_{i}", "source_file": "runs.py", "community": 0, "community_name": "Run"} for i in range(3)]
    nodes += [{"id": f"m{i}", "label": f"odd_thing_{i}", "source_file": "odd.py", "community": 1, "community_name": "Odd"} for i in range(5)]
    doc = {"nodes": nodes, "links": [{"source": "n0", "target": n["id"]} for n in nodes[1:]]}
    root = write(tmp_path / "r", CALIBRATION | {"GLOSSARY.md": "Run, charge and session.", "docs/GLOSSARY.md": "x"})
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc))
    e = evidence.scan(spark, root, graph_path=str(path))
    got = {(r["kind"], r["subject"]) for r in evidence.validation(spark, e, GLOSSARY).collect()}
    assert ("unnamed-structure", "1") in got and ("unnamed-structure", "0") not in got
    drifted = {(r["kind"], r["subject"]) for r in evidence.drift(spark, e, GLOSSARY).collect()}
    assert {("canonical-absent", "workspace:Workspace"), ("canonical-absent", "gateway:Gateway"), ("superseded-present", "gateway:charge")} <= drifted and ("canonical-absent", "run:Run") not in drifted
    out = evidence.document(e, root)
    assert out["structure"]["god_nodes"][0] == {"id": "n0", "degree": 7} and out["structure"]["freshness"] == "unverified"
    assert {g["group"]: (g["size"], g["label"]) for g in out["structure"]["groups"]["items"]} == {"0": (3, "Run"), "1": (5, "Odd")}
    assert out["markdown_glossary"]["state"] == "ok" and out["markdown_glossary"]["nested"] == ["docs/GLOSSARY.md"]
    for text, state in (("{", "malformed"), ('{"nodes": []}', "unusable"), ("[]", "malformed")):
        path.write_text(text)
        assert evidence.read_structure(spark, str(path)).state == state
    assert evidence.read_structure(spark, None).state == "disabled" and evidence.read_structure(spark, str(tmp_path / "no")).state == "absent"


def test_symbol_bindings_lend_their_tokens(spark):
    doc = {"schema_version": 1, "concepts": [{"id": "pay", "term": "Pay", "definition": "d", "status": "canonical", "bindings": [{"ref": "symbol:LedgerEntry"}, {"ref": "module:a"}]}]}
    g = checks.Glossary(glossaries.to_frame(spark, doc), vocabulary.token_occurrences(spark.createDataFrame([], vocabulary.IDENT_OCC)), spark.createDataFrame([], "term string, uses long, files long"))
    assert {r["token"] for r in checks.concept_tokens(g).collect()} == {"pay", "ledger", "entry"}


def test_freshness_takes_short_commits(spark):
    rows = [("a" * 40, "a" * 40, False), ("a" * 7, "a" * 40, False), ("a" * 6, "a" * 40, False), ("b" * 7, "a" * 40, False), ("a" * 40, "a" * 40, True), (None, "a" * 40, False)]
    df = spark.createDataFrame(rows, "recorded string, head string, dirty boolean").coalesce(1)
    got = [r[0] for r in df.select(graph.freshness(F.col("recorded"), F.col("head"), F.col("dirty"))).collect()]
    assert got == ["current", "current", "stale", "stale", "stale", "unverified"]


def test_declared_workspaces(spark, tmp_path):
    root = write(tmp_path, {"package.json": '{"workspaces": ["a"]}', "Cargo.toml": "[package]", "go.work": "use ./a", "a/package.json": '{"workspaces": []}'})
    classified = repository.classify(spark, root)
    assert repository.declared_workspaces(classified, root) == ["go.work", "package.json"]
    (tmp_path / "package.json").write_text("[" * 100_000)
    (tmp_path / "Cargo.toml").write_text("[workspace]")
    assert repository.declared_workspaces(repository.classify(spark, root), root) == ["Cargo.toml", "go.work"]


def test_folders_left_unentered(tmp_path):
    root = write(tmp_path, {"a.py": "x", "vendor/lib/v.py": "x", "vendor/own/o.py": "x", "dist/d.js": "x", "private-secrets/k.py": "x", "build/b.py": "x"})
    listed = {e.path: e.why for e in repository.list_files(root)}
    assert listed == {"a.py": None, "vendor": "vendored", "dist": "generated", "private-secrets": "sensitive", "build": "generated"}
    config = repository.Config.parse({"schema_version": 1, "path_roles": {"production": ["vendor/own", "build"]}})
    listed = {e.path: e.why for e in repository.list_files(root, config)}
    assert listed["vendor/own/o.py"] is None and listed["build/b.py"] is None and listed["vendor/lib/v.py"] is None and listed["dist"] == "generated"
    assert repository.named_exactly(root, "a.py") is True and repository.named_exactly(root, "A.py") is False and repository.named_exactly(root + "/none", "a") is None


def test_confined_existence(tmp_path):
    root = write(tmp_path / "in", {"Makefile": "x"})
    write(tmp_path, {"out.txt": "x"})
    os.symlink(tmp_path / "out.txt", tmp_path / "in" / "link")
    assert checks.exists_confined(root, "Makefile") and not any(checks.exists_confined(root, p) for p in ("../out.txt", str(tmp_path / "out.txt"), "link", "none", ""))
    assert not checks.exists_confined(None, "Makefile")


def test_projection_is_bounded_and_accounts_for_what_it_leaves_out():
    doc = {"a": {"items": [{"t": "x" * 600}] * 30}, "b": list(range(5)), "c": "y" * 300}
    out = report.project(doc, rows=20)
    assert len(out["a"]["items"]) == 20 and len(out["a"]["items"][0]["t"]) == report.TEXT and out["b"] == doc["b"]
    assert out["omissions"] == [{"path": "a/items", "kind": "rows", "times": 1, "amount": 10}, {"path": "a/items/*/t", "kind": "characters", "times": 20, "amount": 20 * 88}]
    small = report.project(doc, rows=20, whole=1000)
    assert "a" not in small and small["omissions"][0]["kind"] == "section" and len(json.dumps(small)) <= 1000
    with pytest.raises(report.TooMuchOmitted):
        report.project({f"k{i}": "z" * 600 for i in range(101)})
    assert report.shown("a\x1b[0m\u202eb") == "a\\x1b[0m\\u202eb"


def test_report_of_findings():
    found = [{"kind": "fragmentation", "subject": "a", "signal_strength": "weak", "certainty": None}]
    sections = [{"kind": "fragmentation", "total": 1, "exact": False, "dropped": 0, "skipped": None, "reasons": ["why"]}, {"kind": "unnamed-structure", "total": 0, "exact": True, "dropped": 0, "skipped": "no graph", "reasons": []}]
    assert report.finding_lines(found, sections) == ["fragmentation: 1 or more", "  a\tweak", "  incomplete: why", "unnamed-structure: skipped (no graph)"]


def test_boundary_totals_without_pairs(spark):
    rows = spark.createDataFrame([("g", f"c{i:02d}", 2) for i in range(40)] + [("h", "x", 3), ("h", "y", 1)], "`group` string, concept string, strength long")
    assert checks.boundary_totals(rows).head()[0] == 780
    sizes = spark.createDataFrame([("g", 9), ("h", 2)], "`group` string, size long")
    pairs = checks.structural(rows, sizes)["boundary"]
    assert pairs.count() == sum(39 - i for i in range(10)) and pairs.orderBy("subject").head()["subject"] == "g:c00:c01"
