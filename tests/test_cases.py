"""Each written-down case, and the operators over texts and claims, against plain Python."""

import random
import sys
import unicodedata

import pytest
from lexiloom.operators import inventory, matching, ownership, vocabulary
from lexiloom.streaming import incremental
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])
import cases  # noqa: E402
import oracle  # noqa: E402


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_case(spark, sf_dir, name):
    query, sql = cases.CASES[name]
    assert oracle.differences(spark, sf_dir, query, sql, oracle.duck(sf_dir)) is None


def test_presence_in_every_spelling_and_script(spark):
    terms = ["Straße", "λόγος", "Café", "ﬁle", "Payment Service", "", "  ", "ab", "abc", "bc"]
    texts = [(1, "STRASSE"), (2, "ΛΌΓΟΣ"), (3, "a CAFE\u0301!"), (4, "profile"), (5, "payment\n  service"), (6, "payment_SERVICE"), (7, "PaymentServices"), (8, "pay ment"), (9, None), (10, ""), (None, "abc"), (1, "payment-service")]
    frame = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, term string")
    got = sorted(((r["id"], r["term"]) for r in matching.term_presence(frame, terms, "doc_id").collect()), key=repr)
    fold = lambda s: " ".join(unicodedata.normalize("NFKC", s).casefold().split())
    want = sorted(((k, t) for k, text in texts if text for t in terms if fold(t) and any(fold(t).replace(" ", by) in fold(text) for by in (" ", "", "_", "-"))), key=repr)
    assert got == want and (2, "λόγος") in got and (7, "Payment Service") in got
    assert matching.term_presence(frame.limit(0), terms, "doc_id").count() == 0 and matching.term_presence(frame, [], "doc_id").count() == 0
    with pytest.raises(ValueError):
        matching.term_presence(frame, [str(i) for i in range(501)], "doc_id")


def test_divergence_within_its_limits(spark, monkeypatch):
    glossary = spark.createDataFrame([(f"c{i}", f"Term{i}", "d", "canonical", None, [(f"old{i}", "alias", None)], [], None) for i in range(4)], cases.glossaries.SCHEMA)
    monkeypatch.setattr(matching, "MOST_TERMS", 3)
    rows, info = matching.markdown_divergence(glossary, "term1 old0")
    assert info == {"checked": 3, "skipped": 5, "complete": False, "reason": "5 term(s) beyond 3"}
    assert {tuple(r)[1:] for r in rows.collect()} == {("Term0", "canonical", "canonical-absent"), ("old0", "alias", "superseded-present")}
    monkeypatch.setattr(matching, "MOST_CHARACTERS", 5)
    rows, info = matching.markdown_divergence(glossary, "term1 old0")
    assert rows.count() == 0 and info["checked"] == 0 and info["skipped"] == 8 and not info["complete"]


def slow_conflicts(claims):
    own = {(w, c, p or None) for w, c, p in claims if w is not None and c is not None}
    out = set()
    for w, c, p in own:
        met = [((len(q or ""), d), d) for v, d, q in own if v == w and d != c and (q is None or p is not None and (p == q or p.startswith(q + "/")))]
        if met:
            out.add((w, c, p, min(met)[1]))
    return out


@pytest.mark.parametrize("parts", [1, 13])
def test_ownership_equals_comparing_all(spark, parts):
    rng = random.Random(parts)
    names = ["a", "a-b", "a.b", "b", "é"]
    claims = [(rng.choice(["w", "w", "w", "v", None]), rng.choice(["c1", "c2", "c3", "c4", None]), rng.choice([None, "", *("/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(8))])) for _ in range(300)]
    claims += [(f"lone{i}", "c1", "a/b") for i in range(5)] + [("same", c, "x/y") for c in ("c3", "c1", "c2")]
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {tuple(r) for r in ownership.ownership_conflicts(spark.createDataFrame(claims, "word string, concept string, prefix string")).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == slow_conflicts(claims) and ("same", "c1", "x/y", "c2") in got
    assert ownership.ownership_conflicts(spark.createDataFrame([], "word string, concept string, prefix string")).count() == 0


def test_inventory_of_modules(spark):
    rows = [("m", "production", "code", "python", 10, None), ("m", "test", "code", "python", 5, None), ("m", "production", "code", "go", None, None), ("m", "production", "doc", None, 7, 3), ("t", "test", "code", "go", 1, None), (None, "production", "doc", None, 2, 4)]
    made = inventory.inventory(spark.createDataFrame(rows, "module string, role string, kind string, language string, size long, words long"))
    got = {r["module"]: r.asDict() for r in inventory.module_inventory(made).collect()}
    assert got == {
        "m": {"module": "m", "code_files": 3, "code_bytes": 15, "languages": {"python": 2, "go": 1}, "code_files_by_role": {"production": 2, "test": 1}, "production": True},
        "t": {"module": "t", "code_files": 1, "code_bytes": 1, "languages": {"go": 1}, "code_files_by_role": {"test": 1}, "production": False},
    }
    assert inventory.totals(made).head().asDict() == {"files": 6, "bytes": 25, "code_files": 4, "code_bytes": 16, "doc_files": 2, "doc_words": 7, "code_files_by_role": {"production": 2, "test": 2}, "doc_files_by_role": {"production": 2}}
    empty = inventory.inventory(spark.createDataFrame([], "module string, role string, kind string, language string, size long, words long"))
    assert inventory.totals(empty).head()["files"] == 0 and inventory.module_inventory(empty).count() == 0


def test_stream_and_batch_fold_alike(spark, tmp_path):
    texts = [("a.md", "The ﬁle λόγος Straße"), ("b.md", unicodedata.normalize("NFD", "Café crème")), ("c.md", "plain words ＷＩＤＥ"), ("d.md", None)]
    files = spark.createDataFrame(texts, "path string, text string")
    batch = vocabulary.doc_occurrences(files).groupBy("term").agg(F.sum("n").alias("uses"))
    files.write.parquet(str(tmp_path / "in"))
    stream = incremental.term_counts(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("folded").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r["term"]: r["uses"] for r in spark.table("folded").collect()}
    assert got == {r["term"]: r["uses"] for r in batch.collect()} and {"file", "λόγοσ", "strasse", "café", "wide"} <= set(got)
