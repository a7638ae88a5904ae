"""BPE, licenses, language, quality and toxicity against libraries, brute force or held-out labels."""

import re
from collections import Counter

import numpy as np
import pytest
from lexiloom.llm import bpe, langid, licenses, quality, queries, toxicity
from tokenizers import Tokenizer

ODD = [None, "", " \n\t", "<|startoftext|>a<|endoftext|>", "it's WE'LL don't", "ΑΣ ΣΑ", "É\u0301 cafe\u0301 İ ß ﬁ", "支付Service 12³ ½", "a\x1cb\x85c\u2028d\u3000e", "hahaha" * 50, "!" * 100, "\U0001f600\U0001f468\u200d\U0001f469"]


def test_bpe_equals_the_library(spark, sf_dir):
    t = Tokenizer.from_file(bpe.default_vocabulary())
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in bpe.bpe_encode(df, emit=("ids", "decoded")).collect()}
    back = {r["id"]: r["decoded"] for r in bpe.bpe_decode(bpe.bpe_encode(df)).collect()}
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["decoded"] == back[i] == t.decode(want, skip_special_tokens=False)


def test_bpe_random_words_equal_the_library():
    t, own = Tokenizer.from_file(bpe.default_vocabulary()), bpe.load(bpe.default_vocabulary())
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcdeinorstäß'1!"), r.integers(1, 25))) for _ in range(3000)]
    for w, found in zip(words, own.encode_batch(words)):
        assert " ".join(x[1] for x in found) == " ".join(map(str, t.encode(w, add_special_tokens=False).ids))


def test_license_templates_are_found(spark):
    lib = licenses.Library(licenses.TEMPLATES)
    r = np.random.default_rng(5)
    filler = lambda n: " ".join("w" + "".join(r.choice(list("abcdef"), 6)) for _ in range(n))
    for spdx, own in licenses.TEMPLATES.items():
        for i, t in enumerate(own):
            for before in (0, 1, 7, 333):
                assert f"{spdx}#{i}" in {m[0] for m in lib.scan(f"{filler(before)} {t} {filler(50)}")}
    long = licenses.TEMPLATES["MIT"][2].split()
    long[20] = "changed"
    assert "MIT#2" in {m[0] for m in lib.scan(" ".join([filler(101), *long, filler(9)]))}
    assert lib.scan(filler(2000)) == []
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, "the MIT")]
    got = licenses.scan_licenses(spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, license string")).collect()
    assert [(x["id"], x["license"], x["containment"]) for x in got] == [(3, "MIT", 1.0)] * 2
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def windowed_containment(lib, text):
    """{template: best containment in a window}, with every window compared and nothing hashed into bands."""
    h, out = licenses.shingle_hashes(licenses.words_of(text or "")), {}
    for name, own in zip(lib.names, lib.shingles, strict=True):
        step, blocks = licenses.window_shape(own.size)
        if np.isin(own, h).mean() < licenses.CONTAINED:
            continue
        best = max((np.isin(own, h[i : i + blocks * step]).mean() for i in range(0, len(h), step)), default=0.0)
        if best >= licenses.CONTAINED:
            out[name] = best
    return out


def test_license_scan_equals_exact_containment(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lib = licenses.Library(licenses.TEMPLATES)
    want = {(r["doc_id"], name, c) for r in docs.collect() for name, c in windowed_containment(lib, r["text"]).items()}
    assert want and {(r["id"], r["template"], r["containment"]) for r in licenses.scan_licenses(docs).collect()} == want


def test_license_edits_and_insertions_equal_exact_containment():
    lib = licenses.Library(licenses.TEMPLATES)
    r = np.random.default_rng(11)
    filler = lambda n: ["w" + "".join(r.choice(list("abcdef"), 6)) for _ in range(n)]
    for name, text in [(f"{spdx}#{i}", t) for spdx, own in licenses.TEMPLATES.items() for i, t in enumerate(own)]:
        own = lib.shingles[lib.names.index(name)].size
        for _ in range(6):
            words = licenses.words_of(text)
            if own >= 30:  # one insertion loses four shingles, of which a fifth may go
                at = int(r.integers(1, len(words)))
                words[at:at] = filler(int(r.integers(1, own - 4)))
            for at in r.choice(len(words), int(r.integers(0, 2)), replace=False):
                words[at] = "changed"
            mixed = " ".join(filler(int(r.integers(0, 300))) + words + filler(int(r.integers(0, 300))))
            got = {m[0]: m[1] for m in lib.scan(mixed)}
            assert got == windowed_containment(lib, mixed)
    assert max((1 - (-(-4 * s // 5) / (np.prod(licenses.window_shape(s)) + s - -(-4 * s // 5))) ** licenses.ROWS) ** licenses.BANDS for s in range(1, 5000)) < 1.3e-5


def test_license_siblings_are_told_apart():
    lib = licenses.Library(licenses.TEMPLATES)
    texts = licenses.TEMPLATES
    for spdx in ("BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSL-1.0", "MIT"):
        got = lib.scan("So says the owner: " + texts[spdx][-1] + " And so on.")
        assert {m[0].rpartition("#")[0] for m in got if m[4] is None} == {spdx}, got
    assert {m[0] for m in lib.scan(texts["GPL-3.0"][1]) if m[4] is None} == {"GPL-3.0#1"}
    apart = lib.scan(texts["GPL-2.0"][0] + " and else " * 60 + texts["AGPL-3.0"][0])
    assert {m[0] for m in apart if m[4] is None} == {"GPL-2.0#0", "AGPL-3.0#0"}
    assert lib.scan(" ".join(["word"] * 200_000) + " " + texts["MIT"][0])[0][:3] == ("MIT#0", 1.0, 200_000)


def test_languages_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()}
    rows = [r for r in docs.collect() if r["lang"] and r["text"] and got[r["doc_id"]]["held_out"]]
    assert len(rows) > 100
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_edges_of_input(spark):
    train = spark.createDataFrame([(i, t, lang, 1) for i in range(30) for t, lang in (("the and of", "en"), ("der und die", "de"), ("le et la", "fr"), ("привет как", "ru"))] + [(None, "x", "en", 1), (5, None, "en", 1), (6, "y", None, 1)], "doc_id long, text string, lang string, score int")
    model = langid.fit_languages(train)
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "the and of"), (4, "the and of"), (None, "le et la"), (7, "der und die " * 100_000)]
    got = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [(r["id"], r["lang_pred"]) for r in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr"), (7, "de")]
    assert langid.fit_languages(train.limit(0)) is None
    assert langid.predict_languages(train.limit(0), None).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(train.limit(3), None).collect()} == {"und"}


def brute_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), base


def test_quality_equals_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + ["", None, " \n \n", "a b c a b c a b c", "é ü " * 40, "x\n\n\nx\n \nx\r\nx", "a " * 100_000, "\u2028 a\u00a0b c"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    for r in quality.quality_verdicts(df).collect():
        assert tuple(r[1:6]) + (r["base_failed"],) == brute_quality(texts[r["id"]]), texts[r["id"]]
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_verdicts(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [5, 7, 10])
def test_repetition_coverage_equals_brute_force(n):
    r = np.random.default_rng(6)
    for _ in range(50):
        x = r.integers(0, 3, r.integers(1, 60))
        grams = Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
        first, later = {}, set()
        for i in range(len(x) - n + 1):
            g = tuple(x[i : i + n])
            if grams[g] > 1 and first.setdefault(g, i) != i:
                later |= set(range(i, i + n))
        assert set(np.flatnonzero(quality.repeated_words(x, n, later_only=True)).tolist()) == later


def test_quality_agrees_with_labels(spark):
    got = {r["id"]: r for r in quality.quality_verdicts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect():
        if not got[r["doc_id"]]["base_failed"]:
            assert got[r["doc_id"]]["kept"] == bool(r["quality"])


def test_toxicity_catches_labelled_documents(spark):
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    bad, clean = [got[r["doc_id"]]["toxic"] for r in labels if r["toxic"]], [got[r["doc_id"]]["toxic"] for r in labels if not r["toxic"]]
    assert np.mean(bad) >= 0.97 and np.mean(clean) <= 0.01


def test_toxicity_on_documents_it_did_not_learn_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    model = toxicity.fit_severity(docs.where("doc_id % 2 = 0"), "doc_id", "text", "toxic")
    got = toxicity.score_severity(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", docs["toxic"].alias("label")), docs["doc_id"] == toxicity.F.col("id")).collect()
    assert np.mean([r["toxic"] for r in got if r["label"]]) >= 0.93
    assert np.mean([r["toxic"] for r in got if not r["label"]]) <= 0.02


def test_ordinal_grades_are_ordered_and_edges_of_input(spark):
    rows = [(i, f"fine plain words {'bad ' if g else ''}{'awful' if g > 1 else ''}", g, 0) for i in range(60) for g in [i % 3]]
    model = toxicity.fit_severity(spark.createDataFrame(rows, "doc_id long, text string, g int, toxic int"), "doc_id", "text", "g")
    assert (np.diff(model.cuts) >= 0).all()
    odd = [(1, None), (2, ""), (3, "!!"), (4, "fine plain words"), (5, "fine plain words bad"), (6, "fine plain words bad awful"), (6, "fine plain words bad awful")]
    got = [r["expected_severity"] for r in toxicity.score_severity(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()]
    assert got[:3] == [0, 0, 0] and got[3] < got[4] < got[5] == got[6]
    empty = spark.createDataFrame([], "doc_id long, text string, g int")
    assert toxicity.fit_severity(empty, "doc_id", "text", "g") is None
    assert toxicity.score_severity(empty, None).count() == 0


def test_score_is_independent_of_the_size_of_a_family():
    langs = "be bg cs hr mk pl ru sk".split()
    r = np.random.default_rng(3)
    words = {lang: ["".join(chr(97 + int(c)) for c in r.choice(26, 6)) for _ in range(12)] for lang in langs}
    texts = [(lang, " ".join(r.choice(words[lang], 40))) for lang in langs for _ in range(20)]
    model = langid.LanguageModel.fit(langid.features([t for _, t in texts]), [lang for lang, _ in texts])
    names, scores = langid.judge([" ".join(r.choice(words[lang], 40)) for lang in langs], model)
    assert names == langs and min(scores) > 0.6


def test_repeated_ids_push_no_language_out(spark):
    """A hundred thousand rows of one id in one language, thirty documents of the other."""
    many = spark.range(100_000).selectExpr("7L AS doc_id", "'the quick brown fox ' || (id % 3) AS text", "'en' AS lang")
    few = spark.createDataFrame([(100 + i, "der schnelle braune fuchs " + "x" * i, "de") for i in range(30)], "doc_id long, text string, lang string")
    sample = langid.sample_rows(many.union(few).withColumnRenamed("doc_id", "id"), 500, "lang", 10).collect()
    assert Counter(r["lang"] for r in sample) == {"en": 1, "de": 30}
    assert langid.fit_languages(many.union(few)).langs == ["de", "en"]
    with pytest.raises(ValueError):
        langid.sample_rows(many.union(few).withColumnRenamed("doc_id", "id"), 500, "lang", 1)


def test_all_grades_are_thresholds(spark):
    """Eighteen grades, each with words of all below it; a repeated id is one document."""
    rows = [(g * 100 + i, " ".join(f"w{chr(97 + k)}ord" for k in range(g)) + " plain text", g) for g in range(18) for i in range(20)]
    rows += [(1700, "wbord", 17)] * 500
    model = toxicity.fit_severity(spark.createDataFrame(rows, "doc_id long, text string, g int"), "doc_id", "text", "g")
    assert len(model.cuts) == 17 and (np.diff(model.cuts) >= 0).all()
    severity, _ = model.expected(model.rows([rows[g * 20][1] for g in range(18)]))
    assert (np.diff(severity)[1:] > 0).all() and severity[:2].max() < severity[3]
    with pytest.raises(ValueError):
        toxicity.fit_severity(spark.range(100).selectExpr("id AS doc_id", "'x' AS text", "int(id) AS g"), "doc_id", "text", "g")


def test_many_distinct_words_are_counted_exactly():
    """Over 2**21 distinct words, where three numbers no longer share a word of 64 bits by shifting."""
    n = (1 << 21) + 50
    words = np.r_[np.arange(n), [5, 6, 7, 3, 4, 9]]
    assert np.flatnonzero(quality.repeated_words(words, 3, later_only=False)).tolist() == [5, 6, 7, n, n + 1, n + 2]
