"""The page of markdown_presence, and word shapes against their plain forms."""

import random

import pytest
from lexiloom.functions import lexical
from lexiloom.operators import matching
from lexiloom.plans import registry, surface
from lexiloom.plans.corpora import table
from pyspark.sql import functions as F

WIDE = "doc_id long, text string, lang string, source string, n_chars long"


def test_only_the_longest_text_is_read(spark, sf_dir, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    want = sorted(map(tuple, registry.queries()["markdown_presence"](spark, sf_dir).collect()))
    monkeypatch.setattr(surface, "table", lambda *at: table(*at).withColumn("text", seen("text")))
    assert sorted(map(tuple, registry.queries()["markdown_presence"](spark, sf_dir).collect())) == want
    assert read.value < 2  # a task that stops at its limit may not hand its count in


def test_the_page_may_have_any_length_and_the_glossary_any_terms(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, registry.queries()["markdown_presence"](spark, sf_dir).collect()))
    monkeypatch.setattr(matching, "MOST_TERMS", 3)
    monkeypatch.setattr(matching, "MOST_CHARACTERS", 5)
    assert sorted(map(tuple, registry.queries()["markdown_presence"](spark, sf_dir).collect())) == want and len(want) > 3


@pytest.mark.parametrize("lengths", [[], [None]])
def test_no_page_makes_no_claim(spark, tmp_path, lengths):
    spark.createDataFrame([(1, None, "en", "a", n) for n in lengths], WIDE).write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.queries()["markdown_presence"](spark, str(tmp_path)).collect() == []


def test_of_the_longest_the_first_id_is_the_page(spark, tmp_path):
    rows = [(3, "three", "en", "a", 9), (None, "none", "en", "a", 9), (2, "two", "en", "a", 9), (1, "one", "en", "a", 8), (0, "null", "en", "a", None)]
    spark.createDataFrame(rows, WIDE).write.parquet(str(tmp_path / "documents.parquet"))
    assert surface._page(spark, str(tmp_path)) == "two"


def test_word_shapes_find_what_their_plain_forms_find(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abzAZ''’’ \n\t.09_éßςΣжЖか支ªµﬁ½İ×÷´́‌‍Ꭰ \u0085") for _ in range(r.randint(0, 14))) for _ in range(4000)]
    texts += ["".join(r.choice("abzAZ'' .") for _ in range(r.randint(0, 12))) for _ in range(2000)]
    letters, t = r"\p{L}[\p{L}\p{M}\x{200c}\x{200d}]*", F.col("t")
    settled = lexical.SETTLED.replace("[[", "[").replace("][", "").replace("]]", "]")
    plain = F.when(F.octet_length(t) == F.char_length(t), F.regexp_extract_all(F.lower(t), F.lit("[a-z]+(?:'[a-z]+)*"), F.lit(0))).otherwise(F.regexp_extract_all(lexical.fold(t), F.lit(rf"{letters}(?:['’]{letters})*"), F.lit(0)))
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", lexical.found_words(t).alias("a"), plain.alias("b"), t.rlike(lexical.SETTLED).alias("c"), t.rlike(settled).alias("d")).collect()
    assert settled.count("[") == 1 and {x["d"] for x in got} == {True, False} and max(len(x["b"]) for x in got) > 3
    assert [x for x in got if (x["a"], x["c"]) != (x["b"], x["d"])] == []
