"""Naming scores over all that there is: inputs beyond the caps that once held, against DuckDB."""

import sys

import duckdb
import numpy as np
import pytest
from lexiloom.operators import pairs, terminology, vocabulary
from lexiloom.plans import corpora, registry, surface  # noqa: F401
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])
import oracle  # noqa: E402


def differences(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return oracle.differences(spark, str(folder), registry.queries()[name], registry.oracle_sql()[name], con)


def test_every_edge_counts_for_the_names_of_modules(spark, tmp_path):
    parts = [(k, f"red word{k % 9} blue", f"Brand#{k // 2}") for k in range(520)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "shared and brand", "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["module"]: r for r in registry.queries()["module_naming_score"](spark, str(tmp_path)).collect()}
    assert got["shared"]["importers"] == 260  # over the 200 edges that import_edges shows
    assert differences(spark, tmp_path, "module_naming_score", "part", "documents") is None
    assert registry.queries()["import_edges"](spark, str(tmp_path)).count() == 200


#: Terms with more than 30 contexts in a module, more than 50 modules, and more than 150 terms; odd sources, words and ends.
ODD = [(i, f"kernel w{'abcdefghij'[i % 10]}{'abcdefg'[i // 10 % 7]} {'klmnopq'[i % 7]}{'rstuvwxyz'[i % 9]} kernel {'doc ' * (i % 3)}pair the pair lone", "en", f"s{i % 60}") for i in range(700)]
ODD += [(1000 + i, f"{'abcdefghij'[i // 3 % 10]}x{'abcdefghij'[i // 30]}y wide kernel", "python", f"s{i % 3}") for i in range(300)]
ODD += [(1, "len print wide doc", "python", "s1"), (1, "Straße ΣΑΣ O'Brien wide Wide", "de", "s2"), (2000, None, "en", "s1"), (2001, "", "en", "s2"), (2002, "solo", "fr", "s3"), (2003, "wide wide wide", None, "s4"), (2003, "wide kernel doc", None, "s4"), (2004, "wide kernel doc", "en", None)]
WIDE = "doc_id long, text string, lang string, source string"


def test_every_term_is_scored_over_all_contexts(spark, tmp_path):
    spark.createDataFrame(ODD, WIDE).write.parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, tmp_path, "term_naming_score", "documents") is None
    got = {r["term"]: r for r in registry.queries()["term_naming_score"](spark, str(tmp_path)).collect()}
    assert len(got) > 150 and len({r["nomination"] for r in got.values()}) == 2 and got["kernel"]["modules"] == 60


@pytest.mark.parametrize("sources", [60, 70])  # modules of one number of 62 bits, and of more
def test_packed_pairs_equal_grouped_pairs(spark, tmp_path, sources):
    rows = ODD + [(3000 + i, "kernel wide wide kernel", "en", f"t{i}") for i in range(sources - 60)]
    spark.createDataFrame(rows, WIDE).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    occ = corpora.word_pairs(spark, str(tmp_path)).cache()
    pats = vocabulary.token_patterns(occ).groupBy("token").agg(F.count("*").alias("compounds"), F.sum("uses").alias("compound_uses"))
    disp = terminology.context_dispersion(occ, None, top=None, cap=None, most=None).withColumnRenamed("term", "token")
    want = {(r["token"], r["compounds"], r["compound_uses"], r["modules"], r["dispersion"]) for r in pats.join(disp, "token", "left").collect()}
    got = corpora.pair_stats(spark, str(tmp_path)).select("*", (F.col("modules") >= 3).alias("told")).collect()
    assert {(r["token"], r["compounds"], r["compound_uses"], r["modules"] if r["told"] else None, round(r["dispersion"], 3) if r["told"] else None) for r in got} == want and len(want) > 150
    occ.unpersist()


def test_dispersion_does_not_depend_on_its_portions(monkeypatch):
    term, kind, contexts = np.array([0, 0, 0, 1, 2, 2]), np.array([0, 1, 2, 0, 1, 2]), np.array([2, 1, 3, 4, 1, 1])
    sets = [["a"], ["a", "b", None], ["b", "c"]]
    want = None
    for cells in (1, 1 << 20):
        monkeypatch.setattr(pairs, "CELLS", cells)
        modules, dispersion = pairs._dispersions(term, kind, contexts, sets, 3)
        got = modules.tolist(), [round(x, 6) for x in dispersion.tolist()]
        assert want in (None, got)
        want = got
    # a: 3, b: 4, c: 3 contexts, one of a in b and three of b in c
    assert want[0] == [4, 1, 4] and want[1][0] == round(1 - (1 / 6 + 3 / 4 + 0) / 3, 6)
