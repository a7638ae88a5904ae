"""Fixed cases whose results are written down, each as a frame and a table of literal rows.

The expectations are the documented behaviour, not what the engine gives; text
beyond ASCII is expected as Python's unicodedata has it.
"""

from __future__ import annotations

import unicodedata

from lexiloom.functions import lexical, paths
from lexiloom.operators import graph, imports, matching, topk, vocabulary
from lexiloom.plans import checks, completeness, context, evidence, glossaries
from lexiloom.sources import repository
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES: dict = {}


def query(sql: str):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add



def _lit(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def expect(columns: str, rows: list[tuple], types: str) -> str:
    """SQL for literal rows; types: one of DuckDB a column."""
    names = columns.split()
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types.split(), strict=True))
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) v({', '.join(names)})"


# Spellings and their vocabulary tokens.
SPELLINGS = [
    ("PaymentService", "payment service"), ("payment_service", "payment service"), ("HTTPServer", "http server"), ("parseJSON2XML", "parse json2 xml"), ("getUserByID", "get user id"),
    ("IDs", "ids"), ("userIDs", "user ids"), ("numCPUs", "num cpus"), ("XMLId", "xml id"), ("ΑΒΓς", "αβγσ"), ("return_value", "value"), ("_private_thing", "thing"), ("ÜberHTTP2Server", "über http2 server"),
    ("支付Service", "支付 service"), (unicodedata.normalize("NFD", "CaféService"), "café service"), ("version_2_value", "version value"), ("x", ""), ("Straße", "strasse"), ("ﬁleName", "file name"), ("ＡＢＣValue", "abc value"),
]
# Texts and their prose words in order of the alphabet.
PROSE = [
    ("a.md", "The ﬁle λόγος", "file λόγοσ"), ("b.md", "Straße STRASSE", "strasse strasse"), ("c.md", unicodedata.normalize("NFD", "Café crème"), "café crème"), ("d.md", "İzmir ＷＩＤＥ", "i̇zmir wide"),
    ("e.md", "The tenant's users’ cafés", "cafés tenant users"), ("f.md", "ΛΌΓΟΣ ŉame ẞharp", "sssharp ŉ λόγοσ".replace("sss", "ss").replace("ŉ", "ʼname")), ("g.md", "", ""),
]


@query(expect("name tokens", SPELLINGS, "VARCHAR VARCHAR"))
def unicode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n, _ in SPELLINGS], "name string")
    return lexical.tokenize_distinct(names).select("name", F.array_join("tokens", " ").alias("tokens"))


@query(expect("path words", [(p, w) for p, _, w in PROSE if w], "VARCHAR VARCHAR"))
def unicode_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = vocabulary.doc_occurrences(spark.createDataFrame([(p, t) for p, t, _ in PROSE], "path string, text string"))
    return occ.groupBy("path").agg(F.array_join(F.array_sort(F.flatten(F.collect_list(F.array_repeat("term", F.col("n").cast("int"))))), " ").alias("words"))


# Source lines and their identifiers.
SOURCES = [("a.py", "python", "ﬁle_name = ＡＢＣ1 + run-job", "ABC1 file_name job run"), ("b.clj", "clojure", "(defn run-job [x] (start! run-job))", "defn run-job run-job start"), ("c.rb", "ruby", "@total = empty? && $name", "empty name total"), ("d.py", "python", "é́tat = 2nd", "nd ét́at".replace("ét́at", unicodedata.normalize("NFKC", "é́tat")))]


@query(expect("path names", [(p, n) for p, _, _, n in SOURCES], "VARCHAR VARCHAR"))
def unicode_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([(p, ".", lang, t) for p, lang, t, _ in SOURCES], "path string, module string, language string, text string")
    occ = vocabulary.code_occurrences(files)
    return occ.groupBy("path").agg(F.array_join(F.array_sort(F.flatten(F.collect_list(F.array_repeat("name", F.col("n").cast("int"))))), " ").alias("names"))


# Paths with kind, language, role, and whether the name is sensitive.
PATHS = [
    ("src/a.py", "code", "python", "production", False), ("lib/b.tsx", "code", "typescript", "production", False), ("docs/c.md", "doc", None, "production", False), ("vendor/x/d.go", "code", "go", "vendored", False),
    ("app/dist/e.js", "code", "javascript", "generated", False), ("testdata/f.rs", "code", "rust", "fixture", False), ("tests/g.rb", "code", "ruby", "test", False), (".env", None, None, "production", True),
    ("conf/secrets.yaml", None, None, "production", True), ("keys/cert.pem", None, None, "production", True), ("Makefile", None, None, "production", False), ("src/h_test.go", "code", "go", "test", False),
]


@query(expect("path kind language role sensitive", PATHS, "VARCHAR VARCHAR VARCHAR VARCHAR BOOLEAN"))
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return spark.createDataFrame([(x[0],) for x in PATHS], "path string").select("path", paths.kind_of(p).alias("kind"), paths.language_of(p).alias("language"), paths.default_role(p).alias("role"), paths.is_sensitive(p).alias("sensitive"))


# Pairs of scopes, null for the whole repository, and whether they overlap.
SCOPES = [(None, "a", True), ("a", "a/b", True), ("a", "ab", False), ("a|b", "c|b/d", True), ("a/b", "a/c", False), (None, None, True)]


@query(expect("a b overlap", SCOPES, "VARCHAR VARCHAR BOOLEAN"))
def scope_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(a, b) for a, b, _ in SCOPES], "a string, b string")
    return rows.select("a", "b", paths.scopes_overlap(F.split("a", r"\|"), F.split("b", r"\|")).alias("overlap"))


# Commit a graph was made at, head, whether the tree is dirty, and the graph's state.
STAMPS = [("abcdef1234", "abcdef1234", False, "current"), ("abcdef1", "abcdef1234", False, "current"), ("abcdef", "abcdef1234", False, "stale"), ("abcdef1234", "abcdef1234", True, "stale"), ("0000000", "abcdef1234", False, "stale"), (None, "abcdef1234", False, "unverified"), ("abcdef1", None, None, "unverified")]


@query(expect("recorded head dirty state", STAMPS, "VARCHAR VARCHAR BOOLEAN VARCHAR"))
def graph_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([s[:3] for s in STAMPS], "recorded string, head string, dirty boolean")
    return rows.withColumn("state", graph.freshness(F.col("recorded"), F.col("head"), F.col("dirty")))


GRAPH = """{"nodes": [{"id": "svc", "label": "Payment Service", "source_file": "src/pay.py", "community": 7, "community_name": "Payments"},
 {"id": "guide", "label": "Billing Guide", "file": "docs/billing.md", "community": 7, "community_name": "Payments"},
 {"name": "gw", "label": "Stripe Gateway", "path": "src/gw.py", "community": "7", "community_name": "Money"},
 {"id": "gl", "label": "Refund", "source_file": "./GLOSSARY.md", "community": 7}, {"label": "no id"}],
 "links": [{"source": "svc", "target": "guide"}, {"from": "svc", "to": "gw"}, {"source": "svc", "target": "gl"}, {"source": "svc", "target": "nowhere"}],
 "communities": []}"""


@query(expect("id label provenance degree", [("svc", "Payment Service", "code", 2), ("guide", "Billing Guide", "doc", 1), ("gw", "Stripe Gateway", "code", 1), ("gl", "Refund", "glossary", 0)], "VARCHAR VARCHAR VARCHAR BIGINT"))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links, _ = graph.parse_graph(spark.createDataFrame([(GRAPH,)], "json string"))
    degrees = graph.node_degrees(graph.visible_links(links, nodes))
    return nodes.join(degrees, "id", "left").select("id", "label", graph.provenance(F.col("source_file")).alias("provenance"), F.coalesce("degree", F.lit(0)).alias("degree"))


@query(expect("\"group\" label size code doc tokens".replace('"', ""), [("7", "Payments", 3, 2, 1, "billing gateway guide payment refund service stripe")], "VARCHAR VARCHAR BIGINT BIGINT BIGINT VARCHAR").replace("CAST(group AS VARCHAR) AS group", 'CAST("group" AS VARCHAR) AS "group"').replace("v(group,", 'v("group",'))
def graph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, _ = graph.parse_graph(spark.createDataFrame([(GRAPH,)], "json string"))
    members = graph.memberships(nodes)
    words = members.join(graph.label_tokens(nodes), "id").groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("tokens"))
    return graph.group_summary(members, nodes).join(graph.group_labels(nodes).select("group", "label"), "group").join(words, "group")


# Cohesion as it stands in a document, and what of it is usable.
COHESIONS = [("0.5", 0.5), ("-1", -1.0), ("1e6", 1000000.0), ("1e7", None), ("true", None), ("NaN", None), ("\"0.5\"", None), ("null", None)]


@query(expect("raw value", COHESIONS, "VARCHAR DOUBLE"))
def cohesion_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r,) for r, _ in COHESIONS], "raw string").select("raw", graph.usable_cohesion(F.col("raw")).alias("value"))


def _concept(**more) -> dict:
    return {"id": "pay", "term": "Payment Service", "definition": "Takes money.", "status": "canonical"} | more


# Concept lists and whether a glossary of them is valid.
GLOSSARIES: list[tuple[str, list, bool]] = [
    *[(f"status {s}", [_concept(status=s)], True) for s in ("canonical", "proposed", "alias", "discouraged", "deprecated", "unknown")],
    ("status other", [_concept(status="old")], False),
    ("canonical alias", [_concept(aliases=[{"term": "Till", "status": "canonical"}])], True),
    ("alias without status", [_concept(aliases=[{"term": "Till"}])], False),
    ("alias note unsafe", [_concept(aliases=[{"term": "Till", "status": "alias", "note": "a‮b"}])], False),
    ("binding kinds", [_concept(bindings=[{"ref": "symbol:Pay"}, {"ref": "file:src/pay.py"}, {"ref": "module:src"}])], True),
    ("binding of a path", [_concept(bindings=[{"ref": "path:src"}])], False),
    ("binding without ref", [_concept(bindings=[{}])], False),
    ("one owner a word", [_concept(), _concept(id="b", term="payment_service")], False),
    ("case apart", [_concept(term="PaymentService"), _concept(id="b", term="payment service")], False),
    ("words before filters", [_concept(term="Limit Function"), _concept(id="b", term="Limit")], True),
    ("disjoint scopes", [_concept(scope={"path_prefixes": ["a"]}), _concept(id="b", scope={"path_prefixes": ["b"]})], True),
    ("scopes that meet", [_concept(scope={"path_prefixes": ["a"]}), _concept(id="b", scope={"path_prefixes": ["x", "a/b"]})], False),
    ("prefixes that overlap", [_concept(scope={"path_prefixes": ["a", "a/b"]})], False),
    ("prefix with a glob", [_concept(scope={"path_prefixes": ["a/*"]})], False),
    ("repeated id", [_concept(), _concept(term="Till")], False),
    ("unknown field", [_concept(color="red")], False),
    ("unsafe text", [_concept(definition="a\x1b[0m")], False),
]


@query(expect("name valid", [(n, v) for n, _, v in GLOSSARIES], "VARCHAR BOOLEAN"))
def glossary_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, not glossaries.validate({"schema_version": 1, "concepts": c})) for n, c, _ in GLOSSARIES], "name string, valid boolean")


_BOUND = {"schema_version": 1, "concepts": [
    {"id": "all", "term": "Widget", "definition": "x", "status": "canonical", "bindings": [{"ref": f} for f in ("symbol:Widget", "symbol:Gone", "file:src/a.py", "file:src", "module:src", "module:src/a.py", "file:vendor/b.py", "file:nowhere.py")]},
    {"id": "part", "term": "Thing", "definition": "x", "status": "canonical", "scope": {"path_prefixes": ["lib"]}, "bindings": [{"ref": f} for f in ("symbol:Widget", "file:src/a.py", "file:lib/c.py", "module:lib")]},
    {"id": "held", "term": "Spire", "definition": "x", "status": "canonical", "bindings": [{"ref": "file:vendor/b.py"}]},
    {"id": "lost", "term": "Ember", "definition": "x", "status": "canonical", "bindings": [{"ref": "file:nowhere.py"}]},
]}


def _bound(spark: SparkSession) -> tuple[checks.Glossary, DataFrame]:
    occ = spark.createDataFrame([("Widget", "src/a.py", "src", "python", 3), ("other", "lib/c.py", "lib", "python", 1)], vocabulary.IDENT_OCC)
    g = checks.Glossary(glossaries.to_frame(spark, _BOUND), vocabulary.token_occurrences(occ), spark.createDataFrame([], "term string, uses long, files long"))
    return g, checks.bindings(g, spark.createDataFrame([("src/a.py",), ("lib/c.py",)], "path string"), excluded=["vendor"])


@query(expect("concept ref state", [
    ("all", "symbol:Widget", "resolved"), ("all", "symbol:Gone", "unresolved"), ("all", "file:src/a.py", "resolved"), ("all", "file:src", "unresolved"), ("all", "module:src", "resolved"), ("all", "module:src/a.py", "unresolved"), ("all", "file:vendor/b.py", "uncertain"), ("all", "file:nowhere.py", "unresolved"),
    ("part", "symbol:Widget", "out-of-scope"), ("part", "file:src/a.py", "out-of-scope"), ("part", "file:lib/c.py", "resolved"), ("part", "module:lib", "resolved"), ("held", "file:vendor/b.py", "uncertain"), ("lost", "file:nowhere.py", "unresolved"),
], "VARCHAR VARCHAR VARCHAR"))
def binding_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark)[1]


@query(expect("subject signal_strength", [("lost", "strong")], "VARCHAR VARCHAR"))
def orphan_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept held by an uncertain binding is no orphan."""
    return checks.orphaned_concepts(*_bound(spark)).select("subject", "signal_strength")


# A term in the contexts of several modules.
def _sessions(spark: SparkSession, contexts: dict[str, str], scopes: list[list[str] | None]) -> tuple[checks.Glossary, DataFrame]:
    rows = [(f"session_{c}", f"{m}/session.py", m, "python", 1) for m, own in contexts.items() for c in own.split()]
    tok = vocabulary.token_occurrences(spark.createDataFrame(rows, vocabulary.IDENT_OCC))
    concepts = [{"id": f"c{i}", "term": "Session", "definition": "x", "status": "canonical"} | ({"scope": {"path_prefixes": p}} if p else {}) for i, p in enumerate(scopes)]
    g = checks.Glossary(glossaries.to_frame(spark, {"schema_version": 1, "concepts": concepts}), tok, spark.createDataFrame([], "term string, uses long, files long"))
    spread = spark.createDataFrame([("session", 1.0, len(contexts), True)], "term string, dispersion double, modules long, divergent boolean")
    return g, spread


@query(expect("name subject signal_strength value", [("whole", "c0:Session", "strong", 1.0), ("three of four", "c0:Session", "strong", 1.0)], "VARCHAR VARCHAR VARCHAR DOUBLE"))
def scoped_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overloads of an unscoped concept, of one scope a module, of a scope over three modules, and of one whose five modules the evidence shows in part."""
    four = {"auth": "login cookie", "db": "commit query", "ml": "model batch", "ui": "frame click"}
    out = None
    for name, contexts, scopes in (("whole", four, [None]), ("one each", four, [["auth"], ["db"], ["ml"]]), ("three of four", four, [["auth", "db", "ml"]]), ("in part", four | {"os": "fork signal"}, [["auth", "db", "ml"]])):
        rows = checks.canonical_overloaded(*_sessions(spark, contexts, scopes)).select(F.lit(name).alias("name"), "subject", "signal_strength", "value")
        out = rows if out is None else out.union(rows)
    return out


# Import lines by file, and the modules they lead to.
IMPORTS = [("app/main.rs", "rust", "use crate::net;\nuse serde::Deserialize;\n"), ("net/mod.rs", "rust", "use self::wire::Frame;\nuse super::app;\n"), ("net/wire.rs", "rust", "x\n"), ("pkg/sub/a.py", "python", "from ..base import b\nfrom . import c\nimport os\n"), ("pkg/base.py", "python", "x = 1\n"), ("web/index.js", "javascript", "import x from '../lib/util'\nimport y from 'lodash'\nimport './style.css'\n"), ("lib/util.js", "javascript", "x\n")]


@query(expect("path spec target external", [
    ("app/main.rs", "crate::net", "net", None), ("app/main.rs", "serde::Deserialize", None, "serde"), ("net/mod.rs", "self::wire::Frame", "net", None), ("net/mod.rs", "super::app", "app", None),
    ("pkg/sub/a.py", "..base", "pkg", None), ("pkg/sub/a.py", ".", "pkg/sub", None), ("pkg/sub/a.py", "os", None, "os"), ("web/index.js", "../lib/util", "lib", None), ("web/index.js", "lodash", None, "lodash"), ("web/index.js", "./style.css", None, None),
], "VARCHAR VARCHAR VARCHAR VARCHAR"))
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(IMPORTS, "path string, language string, text string")
    return imports.resolve(imports.import_specs(files), files).select("path", "spec", "target", "external")


# A Markdown glossary, a structured one, and where they differ.
PAGE = "# Terms\nThe **Payment\n Service** takes money. An order-line is kept; see LedgerEntry. Die STRASSE, λόγος, Cafe\u0301 and the ﬁle. Old word: basket, wagon.\n"
TERMS = [
    ("a", "Payment Service", []), ("b", "Refund", [("Repayment", "alias")]), ("c", "Order Line", [("wagon", "deprecated")]), ("d", "Cart", [("Basket", "discouraged"), ("Wagon", "canonical"), ("Trolley", "alias")]),
    ("e", "Ledger Entry", []), ("f", "Straße", []), ("g", "ΛΌΓΟΣ", []), ("h", "Café", []), ("i", "File", []), ("j", "Wagons", [("wagon", "deprecated")]),
]


@query(expect("concept term kind", [("b", "Refund", "canonical-absent"), ("d", "Cart", "canonical-absent"), ("d", "Basket", "superseded-present"), ("j", "Wagons", "canonical-absent"), ("j", "wagon", "superseded-present")], "VARCHAR VARCHAR VARCHAR"))
def markdown_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = [(i, t, "d", "canonical", None, [(x, status, None) for x, status in aliases], [], None) for i, t, aliases in TERMS] + [("z", "basket", "d", "deprecated", None, [], [], None)]
    return matching.markdown_divergence(spark.createDataFrame(concepts, glossaries.SCHEMA), PAGE)[0].select("concept", "term", "kind")


# Totals, kept rows, exactness, reasons, and the ledger they make.
LEDGERS = [(3, 3, True, "", 0, True), (5, 3, True, "cap", 2, False), (3, 3, False, "", 0, False), (3, 3, True, "why|why", 0, False), (0, 0, True, "", 0, True)]


@query(expect("total included exact reasons dropped complete", [(t, i, e, "|".join(dict.fromkeys(filter(None, r.split("|")))), d, c) for t, i, e, r, d, c in LEDGERS], "BIGINT BIGINT BOOLEAN VARCHAR BIGINT BOOLEAN"))
def coverage_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [topk.ledger(t, i, e, [x for x in r.split("|") if x]) for t, i, e, r, _, _ in LEDGERS]
    return spark.createDataFrame([(m["total_items"], m["included_items"], m["total_items_exact"], "|".join(m["reasons"]), m["dropped_items"], m["complete"]) for m in made], "total long, included long, exact boolean, reasons string, dropped long, complete boolean")


# Texts, byte limits and what is left.
CUTS = [("short", 10, "short"), ("abcdefgh", 6, "abc…"), ("ééééé", 8, "éé…"), ("", 4, "")]


@query(expect("text most kept", CUTS, "VARCHAR BIGINT VARCHAR"))
def byte_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, n, evidence.shorten(t, n)) for t, n, _ in CUTS], "text string, most long, kept string")


_HOST = f"before\n{evidence.BEGIN} x -->\nPayment\n{evidence.END}\nafter\n"


@query(expect("text kept", [(_HOST, "before\n\nafter\n"), ("no block", "no block")], "VARCHAR VARCHAR"))
def stripped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(_HOST,), ("no block",)], "text string")
    return rows.select("text", repository.strip_block(F.col("text"), evidence.BEGIN, evidence.END).alias("kept"))


@query(expect("host state", [("current", "current"), ("none", "absent"), ("unread", "uninspectable")], "VARCHAR VARCHAR"))
def context_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = glossaries.STANDING
    hosts = {"current": "x\n" + context.render(doc), "none": "x\n", "unread": None}
    return spark.createDataFrame([(k, context.status(t, doc)) for k, t in hosts.items()], "host string, state string")


@query(expect("kind total included dropped exact complete skipped reasons", [
    ("unnamed-structure", 0, 0, 0, False, False, completeness.SCOPED, f"corpus: 2 file(s) or folder(s) left out: corpus-budget|{completeness.SCOPED}"),
    ("fragmentation", 12, 10, 2, False, False, None, "corpus: 2 file(s) or folder(s) left out: corpus-budget|the cap is 10 findings"),
    ("canonical-overloaded", 1, 1, 0, False, False, None, "corpus: 2 file(s) or folder(s) left out: corpus-budget|1 scoped overload check(s) omitted: modules or contexts are shown in part"),
], "VARCHAR BIGINT BIGINT BIGINT BOOLEAN BOOLEAN VARCHAR VARCHAR"))
def finding_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section a kind: exact totals, what the cap drops, and the reasons of its inputs."""
    found = spark.createDataFrame([("fragmentation", str(i)) for i in range(12)] + [("canonical-overloaded", "a"), ("unnamed-structure", "g")], "kind string, subject string")
    undecided = spark.createDataFrame([("c", "t", False, None), ("d", "t", True, 0.9)], "concept string, term string, whole boolean, dispersion double")
    planned = completeness.plan(("unnamed-structure", "fragmentation", "canonical-overloaded"), completeness.corpus_reasons({"corpus-budget": 2, "ignored": 4}), completeness.overload_reasons(undecided), "ok", [], 1)
    return completeness.sections(found, planned).withColumn("reasons", F.array_join("reasons", "|"))


@query(expect("status concepts aliases", [("canonical", len([c for c in glossaries.STANDING["concepts"] if c["status"] == "canonical"]), 0), ("deprecated", 1, 0), ("discouraged", 0, 1), ("alias", 0, 1)], "VARCHAR BIGINT BIGINT"))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completeness.status_counts(glossaries.to_frame(spark, glossaries.STANDING))
