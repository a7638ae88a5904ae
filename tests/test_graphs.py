"""Graph documents in pieces, and their budgets."""

import json
import random

import pytest
from lexiloom.operators import graph
from lexiloom.plans import checks, evidence
from lexiloom.sources import documents, graphs
from pyspark.sql import functions as F


def some_graph(rng, n=60):
    text = lambda: rng.choice(["plain", "quote \" here", "br]ack,et}", "é\n\t", "\\", ""])
    return {
        "built_at_commit": "abc1234", "nodes": [{"id": i, "label": f"{text()} {i}", "more": {"a": [1, {"b": text()}]}} for i in range(n)] + [{"id": 0, "label": "again"}],
        "edges": [{"source": rng.randrange(n), "target": rng.randrange(n)} for _ in range(n)], "communities": [{"id": k, "nodes": list(range(k, n, 7))} for k in range(7)], "x": [1, 2],
    }


@pytest.mark.parametrize("piece, indent", [(1, None), (200, 2), (10**6, None)])
def test_pieces_hold_the_elements(spark, piece, indent):
    doc = some_graph(random.Random(piece))
    cut = graphs.cut_graph("\n " + json.dumps(doc, indent=indent, ensure_ascii=False) + " ", piece)
    assert cut.values == {"built_at_commit": "abc1234", "x": [1, 2]}
    assert cut.refs == 61 + 60 + 7 + 60
    for name in ("nodes", "edges", "communities"):
        assert [e for _, text in cut.pieces[name] for e in json.loads(text)] == doc[name]
        assert [first for first, _ in cut.pieces[name]][0] == 0
        at = 0
        for first, text in cut.pieces[name]:
            assert first == at
            at += len(json.loads(text))
    frame = cut.frame(spark)
    got = graph.graph_tables(graphs.elements(frame, "nodes"), graphs.elements(frame, "links", "edges"), graphs.elements(frame, "communities"))
    want = graph.parse_graph(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    for a, b in zip(got, want, strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("text", ["", "[]", "{", '{"nodes": [1,]}', '{"nodes": [1 2]}', '{"nodes": [1]', '{"nodes": [1]} x', '{"a": NaN}', '{"nodes": [NaN]}', "{1: 2}", '{"a" 1}', '{"nodes": ' + "[" * 100_000])
def test_what_is_no_graph_document(tmp_path, text):
    path = tmp_path / "g.json"
    path.write_text(text)
    assert graphs.read_graph(str(path)) == ("malformed", None)
    assert documents.read_json(str(path))[0] == ("ok" if text == "[]" else "malformed")


def test_odd_but_valid_documents():
    assert graphs.cut_graph("{}").refs == 0
    assert graphs.cut_graph('{"nodes": [], "nodes": [{"id": 1}]}').pieces["nodes"] == [(0, '[{"id": 1}]')]
    assert graphs.cut_graph('{"nodes": [1], "nodes": null}').pieces == {}
    assert graphs.cut_graph('{ "links" :[ ] , "nodes":[ 1 , "]" ] }').counts == {"links": 0, "nodes": 2}


def test_budgets_are_judged_before_the_work(spark, tmp_path, monkeypatch):
    path = tmp_path / "g.json"
    assert evidence.read_structure(spark, str(path)).state == "absent"
    path.write_text(json.dumps({"nodes": [], "links": []}))
    assert evidence.read_structure(spark, str(path)).state == "unusable"
    path.write_text(json.dumps(some_graph(random.Random(1))))
    s = evidence.read_structure(spark, str(path))
    assert s.state == "ok" and s.commit == "abc1234" and s.nodes.count() == 60
    monkeypatch.setitem(evidence.LIMITS, "graph_label_chars", 50)
    assert evidence.read_structure(spark, str(path)).state == "too-much-work"
    monkeypatch.setitem(evidence.LIMITS, "graph_refs", 187)
    monkeypatch.setattr(evidence.graph, "label_characters", lambda nodes: pytest.fail("labels were read"))
    assert evidence.read_structure(spark, str(path)).state == "too-much-work"


def test_member_tokens_and_samples(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"alpha_{chr(97 + i)}word", "a.py" if i else "GLOSSARY.md", "g", None) for i in range(6)], "id string, label string, source_file string, community string, community_name string")
    members = graph.memberships(nodes)
    kept, over = graph.member_tokens(members, nodes, 3)
    assert sorted(r["token"] for r in kept.collect()) == ["alpha", "bword", "cword"] and tuple(over.head()) == ("g", 6, 3)
    assert graph.member_tokens(members, nodes)[1].count() == 0
    degrees = spark.createDataFrame([("n5", 4), ("n2", 9)], "id string, degree long")
    assert graph.member_samples(members, nodes, degrees, 3).head()["members"] == ["alpha_cword", "alpha_fword", "alpha_bword"]


def test_findings_of_groups_carry_members_and_concepts(spark):
    strengths = spark.createDataFrame([("g", c, 2) for c in ("a", "b", "c")], "`group` string, concept string, strength long")
    sizes = spark.createDataFrame([("g", 9), ("h", 5)], "`group` string, size long")
    samples = spark.createDataFrame([("g", ["x"]), ("h", ["y", "z"])], "`group` string, members array<string>")
    found = checks.structural(strengths, sizes, samples)
    h = found["unnamed"].head()
    assert h["evidence"]["size"] == 5 and h["evidence"]["members"] == ["y", "z"] and "5 members" in h["summary"] and h["signal_strength"] == "strong"
    assert sorted(tuple(r["evidence"]["concepts"]) for r in found["boundary"].collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert found["overloaded"].head()["evidence"]["concepts"] == ["a", "b", "c"]
    assert found["overloaded"].select(F.col("evidence.similarity")).head()[0] is None
