"""Lexical vectors."""

import pytest
from lexiloom.functions import lexical
from lexiloom.functions.paths import default_role, module_of
from pyspark.sql import functions as F

VECTORS = {
    "PaymentService": "payment service", "payment_service": "payment service", "paymentService": "payment service", "HTTPServer": "http server",
    "parseJSON2XML": "parse json2 xml", "getUserByID": "get user id", "IDs": "ids", "URLs": "urls", "userIDs": "user ids", "numCPUs": "num cpus",
    "XMLId": "xml id", "ΑΒΓς": "αβγσ", "return_value": "value", "_private_thing": "thing", "ÜberHTTP2Server": "über http2 server",
    "支付Service": "支付 service", "CaféService": "café service", "version_2_value": "version value", "x": "", "HTTP2Server": "http2 server",
    "Straße": "strasse", "": "",
}
STYLES = {"snake_case": "snake_case", "camelCase": "camelCase", "PascalCase": "PascalCase", "UPPER_SNAKE": "UPPER_SNAKE", "flat": "flat", "HTTP": "upper", "a-b": "kebab-case", "_private": "flat", "X": "upper", "HTTPServer": "PascalCase"}


def test_tokens(spark):
    df = spark.createDataFrame([(n,) for n in VECTORS], "name string")
    got = {r["name"]: " ".join(r["tokens"]) for r in lexical.tokenize_distinct(df).collect()}
    assert got == VECTORS
    assert {n: " ".join(lexical.split_tokens(n)) for n in VECTORS} == VECTORS


def test_native_and_python_agree_on_ascii(spark):
    import random

    r = random.Random(3)
    names = ["".join(r.choice("aAbBsS01_Z") for _ in range(r.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(n,) for n in set(names)], "name string").withColumns({"t": lexical.tokens(F.col("name")), "w": lexical.term_words(F.col("name"))})
    for x in df.collect():
        assert x["t"] == lexical.split_tokens(x["name"]) and x["w"] == lexical.split_term(x["name"])


def test_styles(spark):
    df = spark.createDataFrame([(n,) for n in STYLES], "name string")
    assert {r["name"]: r["s"] for r in df.select("name", lexical.identifier_style(F.col("name")).alias("s")).collect()} == STYLES


@pytest.mark.parametrize(("text", "words"), [("The tenant's users' cafés", "tenant users cafés"), ("an Über-Straße x1y", "über strasse"), ("", "")])
def test_prose_words(spark, text, words):
    got = spark.createDataFrame([(text,)], "t string").select(lexical.doc_words(F.col("t"))).head()[0]
    assert " ".join(got) == words


def test_identifiers_and_kebab(spark):
    df = spark.createDataFrame([("def run-job(x, $foo) return 2nd foo?", "clojure"), ("run-job a_b", "python")], "t string, l string")
    got = [r[0] for r in df.select(lexical.identifiers(F.col("t"), F.col("l"))).collect()]
    assert got == [["run-job", "foo", "nd", "foo"], ["run", "job", "a_b"]]


def test_paths(spark):
    want = {"a.py": (".", "production"), "x/vendor/y/z.py": ("x/vendor/y", "vendored"), "tests/a.py": ("tests", "test"), "src/a_test.go": ("src", "test"), "src/api.generated.ts": ("src", "generated"), "testdata/x.py": ("testdata", "fixture"), "Build/x.py": ("Build", "generated"), "conftest.py": (".", "test")}
    df = spark.createDataFrame([(p,) for p in want], "p string").select("p", module_of(F.col("p")), default_role(F.col("p")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == want


def test_sql_functions(spark):
    lexical.register(spark)
    assert spark.sql("select tokenize_identifier('ÜberHTTP2Server'), term_words('LimitFunction')").head() == (["über", "http2", "server"], ["limit", "function"])
