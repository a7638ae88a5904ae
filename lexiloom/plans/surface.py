"""More standing queries: listings, lexical rules, graph documents and the sections of findings, over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical, paths
from ..functions.fixed import KEYWORDS, STOPWORDS
from ..operators import graph, imports, matching, topk
from ..sources import graphs, repository
from ..sources.shared import cut
from . import checks, completeness, evidence, glossaries
from .corpora import _L, DOC, IDENT, _list, table
from .registry import _BIND, _GRAPH, _LINKED, _PATHS, _STR, _USES, PLAIN, _docs, _glossary, _has, _listing, _states, _strengths, _values, query


def _pick(names: list[str], n: F.Column) -> F.Column:
    """The name whose place is the remainder of ``n``."""
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))


def _sql(names: list[str], n: str) -> str:
    return f"[{', '.join(_quoted(x) for x in names)}][1 + {n} % {len(names)}]"


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


# Listings and paths.

_SAID = " ".join(f"WHEN {_quoted(k)} THEN replace({_quoted(v)}, '%d', count(*)::VARCHAR)" for k, v in repository.SENTENCES.items())


@query(f"""WITH {_PATHS}, {_LINKED}, v AS (SELECT l.path, coalesce(a.verdict, CASE WHEN link AND target IS NULL THEN 'symlink-escapes' WHEN b.verdict = 'sensitive' THEN 'sensitive' WHEN b.verdict IS NOT NULL THEN 'symlink-excluded' WHEN size > 2000000 THEN 'too-large' END) AS exclusion_kind
  FROM listed l JOIN said a ON a.path = l.path LEFT JOIN said b ON b.path = l.target), r AS (SELECT *, row_number() OVER (PARTITION BY exclusion_kind ORDER BY path) AS r FROM v WHERE exclusion_kind IS NOT NULL)
SELECT exclusion_kind, count(*) AS files, string_agg(path, ' ' ORDER BY path) FILTER (r <= 20) AS sample, CASE exclusion_kind {_SAID} END AS sentence FROM r GROUP BY exclusion_kind""")
def exclusion_ledger(spark, sf):
    config = repository.Config.parse({"schema_version": 1, "ignore_paths": ["src/skipped"]})
    got = repository.exclusion_ledger(repository.judge(_listing(spark, sf), config))
    return got.select("exclusion_kind", "files", F.array_join("sample", " ").alias("sample"), "sentence")


#: Names with their kind, language and whether they may hold secrets.
_NAMES = [("a.py", "code", "python", False), ("b.tsx", "code", "typescript", False), ("c.md", "doc", None, False), (".env", None, None, True), ("conf-secret.yaml", None, None, True), ("Makefile", None, None, False), ("h_test.go", "code", "go", False), ("cert.pem", None, None, True), ("i.generated.rs", "code", "rust", False), ("K.JAVA", "code", "java", False)]
_FOLDERS = ["src", "tests/x", "vendor/lib", "app/build", "fixtures", "docs/target/deep", "lib"]


@query(f"""WITH n AS (SELECT doc_id, {_sql(_FOLDERS, "doc_id")} || '/' || source || '/' || {_sql([x[0] for x in _NAMES], "(doc_id // 7)")} AS path, {_sql([x[1] for x in _NAMES], "(doc_id // 7)")} AS kind, {_sql([x[2] for x in _NAMES], "(doc_id // 7)")} AS language, [{", ".join(str(x[3]).lower() for x in _NAMES)}][1 + (doc_id // 7) % {len(_NAMES)}] AS sensitive FROM documents)
SELECT doc_id, path, kind, language, sensitive, CASE WHEN {_has('vendored')} THEN 'vendored' WHEN {_has('generated')} OR contains(path, '.generated.') THEN 'generated' WHEN {_has('fixture')} THEN 'fixture' WHEN {_has('test')} OR ends_with(path, '/h_test.go') THEN 'test' ELSE 'production' END AS role FROM n""")
def path_classes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    path = F.concat(_pick(_FOLDERS, F.col("doc_id")), F.lit("/"), "source", F.lit("/"), _pick([x[0] for x in _NAMES], F.floor(F.col("doc_id") / 7)))
    p = F.col("path")
    return d.select("doc_id", path.alias("path")).select("doc_id", "path", paths.kind_of(p).alias("kind"), paths.language_of(p).alias("language"), paths.is_sensitive(p).alias("sensitive"), paths.default_role(p).alias("role"))


_FILES = ["package.json", "a.py", "Cargo.toml", "x.md", "b.go"]


@query(f"""WITH n AS (SELECT source AS module, {_sql(_FILES, "doc_id")} AS name FROM documents)
SELECT count(DISTINCT module) FILTER (name IN ('package.json', 'Cargo.toml')) AS roots, count(*) FILTER (name IN ('a.py', 'b.go')) AS code_files, roots >= 3 OR code_files >= 5000 AS monorepo FROM n""")
def monorepo_signs(spark, sf):
    path = F.concat("source", F.lit("/"), _pick(_FILES, F.col("doc_id")))
    d = table(spark, sf, "documents").select(path.alias("path"), F.col("source").alias("module"))
    return repository.monorepo(d.withColumn("kind", paths.kind_of(F.col("path"))))


# Lexical rules over whole texts.


@query(f"""WITH n AS (SELECT doc_id, list_filter(regexp_extract_all(nfc_normalize(text), '[\\p{{L}}_][\\p{{L}}\\p{{M}}\\p{{N}}_\\x{{200C}}\\x{{200D}}]*'), lambda w: length(w) >= 2 AND lower(w) NOT IN ({_list(KEYWORDS)})) AS names FROM documents)
SELECT doc_id, len(names)::BIGINT AS identifiers, len(list_distinct(names))::BIGINT AS distinct_names FROM n""")
def text_identifiers(spark, sf):
    texts = lexical.normalize_text(table(spark, sf, "documents").select("doc_id", "text"), "text")
    names = lexical.identifiers(F.col("text"))
    return texts.select("doc_id", names.alias("names")).select("doc_id", F.size("names").cast("long").alias("identifiers"), F.size(F.array_distinct("names")).cast("long").alias("distinct_names"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(nfc_normalize(text), '{_L}(?:[''’]{_L})*'), lambda w: regexp_replace(replace(replace(lower(w), 'ß', 'ss'), 'ς', 'σ'), '[''’]s$', '')), lambda w: length(w) >= 3 AND w NOT IN ({_list(STOPWORDS)}) AND regexp_full_match(w, '\\p{{L}}+')) AS w FROM documents)
SELECT doc_id, array_to_string(list_filter([w[1], w[2] || '2'], lambda x: x NOT IN ({_list([*KEYWORDS, *STOPWORDS])})), ' ') AS tokens FROM w WHERE len(w) >= 2""")
def unicode_tokens(spark, sf):
    """A document's first two words, capitalised and joined, are split again."""
    texts = lexical.normalize_text(table(spark, sf, "documents").select("doc_id", "text"), "text", form="FOLD")
    # Null where there are fewer words: a filter by size would be pushed below and read every text twice.
    words = texts.select("doc_id", F.slice(F.filter(lexical.doc_words(F.col("text")), lambda w: w.rlike(r"^\p{L}+$")), 1, 2).alias("w"))
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    named = cut(words.select("doc_id", F.concat(title(F.get("w", 0)), title(F.get("w", 1)), F.lit("2")).alias("name"))).where("name is not null")
    return lexical.tokenize_distinct(named).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


_BLOCK = f"{evidence.BEGIN} x -->inner{evidence.END}"


@query(f"""SELECT doc_id, sha256(CASE doc_id % 3 WHEN 2 THEN concat({_quoted(_BLOCK)}, text, {_quoted(evidence.BEGIN)}) ELSE text END) AS kept FROM documents""")
def stripped_blocks(spark, sf):
    """One managed block is cut out wherever it stands; a text with more markers stays whole."""
    d, at = table(spark, sf, "documents").select("doc_id", "text"), F.col("doc_id") % 3
    held = F.when(at == 1, F.concat(F.substring("text", 1, 40), F.lit(_BLOCK), F.substring("text", 41, 1 << 30))).when(at == 2, F.concat(F.lit(_BLOCK), "text", F.lit(evidence.BEGIN))).otherwise(F.col("text"))
    return d.select("doc_id", held.alias("text")).select("doc_id", F.sha2(repository.strip_block(F.col("text"), evidence.BEGIN, evidence.END), 256).alias("kept"))


@query(f"""WITH {DOC}, ranked AS (SELECT term, row_number() OVER (ORDER BY uses DESC, term) AS r FROM doc_counts), page AS (SELECT regexp_replace(replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ς', 'σ'), '\\s+', ' ', 'g') AS p FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1),
c AS (SELECT a.r AS n, a.term, b.term AS old, contains(p, a.term) AS held, contains(p, b.term) AS old_held FROM ranked a JOIN ranked b ON b.r = a.r + 120 CROSS JOIN page WHERE a.r BETWEEN 101 AND 220)
SELECT 'c' || n AS concept, term, 'canonical-absent' AS kind FROM c WHERE NOT held UNION ALL SELECT 'c' || n, old, 'superseded-present' FROM c WHERE NOT held AND old_held""")
def markdown_presence(spark, sf):
    """The longest document as a Markdown glossary, against common words as terms and less common ones as their old names."""
    terms = [r["term"] for r in topk.top_k(_docs(spark, sf), 340, F.desc("uses"), F.asc("term")).collect()]
    page = _page(spark, sf)
    rows = [] if page is None else [(f"c{i + 1}", terms[i], "x", "canonical", None, [(terms[i + 120], "deprecated", None)], [], None) for i in range(100, min(220, len(terms) - 120))]
    return matching.markdown_divergence(spark.createDataFrame(rows, glossaries.SCHEMA), page or "", whole=True)[0].select("concept", "term", "kind")


def _page(spark, sf) -> str | None:
    """The longest document's text, of those alike the first by id: its row is found without the texts, of which only that one is then read."""
    d, by = table(spark, sf, "documents"), ["n_chars", "doc_id"]
    longest = d.select(*by).orderBy(F.desc("n_chars"), F.asc_nulls_last("doc_id")).head()
    text = longest and d.where(reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(longest[c]) for c in by])).select("text").first()
    return text and text[0]


# Graph documents.

_NODE = """SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 3 THEN 's' || s_suppkey ELSE s_name END AS label, CASE s_suppkey % 4 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'docs/b.md' WHEN 2 THEN 'GLOSSARY.md' END AS source_file, s_nationkey::VARCHAR AS community FROM supplier"""


@query(f"""WITH n AS ({_NODE}) SELECT id, label, source_file, community, CASE WHEN source_file = 'GLOSSARY.md' THEN 'glossary' WHEN source_file = 'docs/b.md' THEN 'doc' ELSE 'code' END AS provenance FROM n""")
def graph_elements(spark, sf):
    """Suppliers as nodes of a graph document in pieces, under other keys by turns; each node stands twice, the later one holds."""
    s, at = table(spark, sf, "supplier"), F.col("s_suppkey") % 4
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    own = F.when(at == 0, F.to_json(F.struct(name.alias("id"), F.col("s_name").alias("label"), F.lit("src/a.py").alias("source_file"), F.col("s_nationkey").alias("community"))))
    own = own.when(at == 1, F.to_json(F.struct(name.alias("name"), F.col("s_name").alias("label"), F.lit("docs/b.md").alias("file"), F.col("s_nationkey").cast("string").alias("community"))))
    own = own.when(at == 2, F.to_json(F.struct(F.lit("").alias("id"), name.alias("name"), F.col("s_name").alias("label"), F.lit("").alias("file"), F.lit("GLOSSARY.md").alias("path"), F.col("s_nationkey").alias("community"))))
    own = own.otherwise(F.to_json(F.struct(name.alias("id"), F.lit("").alias("label"), F.col("s_nationkey").alias("community"))))
    old = F.to_json(F.struct(name.alias("id"), F.lit("old").alias("label")))
    rows = s.select((F.col("s_suppkey") % 20).alias("piece"), "s_suppkey", F.lit(1).alias("late"), own.alias("o")).union(s.select((F.col("s_suppkey") % 20).alias("piece"), "s_suppkey", F.lit(0), old))
    pieces = rows.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("late", "s_suppkey", "o"))).alias("all"))
    pieces = pieces.select(F.lit("nodes").alias("section"), (F.col("piece") * 1_000_000).cast("long").alias("first"), F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["o"]), ","), F.lit("]")).alias("json"))
    none = graphs.elements(pieces, "links", "edges")
    nodes = graph.graph_tables(graphs.elements(pieces, "nodes"), none, none)[0]
    return nodes.select("id", "label", "source_file", "community", graph.provenance(F.col("source_file")).alias("provenance"))


@query("""WITH p AS (SELECT p_partkey, sha256(p_name) AS made, CASE WHEN p_partkey % 3 = 0 THEN sha256(p_brand) ELSE sha256(p_name) END AS head, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 5 = 0 END AS dirty, 4 + p_partkey % 9 AS digits FROM part)
SELECT p_partkey, CASE WHEN dirty IS NULL THEN 'unverified' WHEN dirty OR digits < 7 OR left(made, digits) <> left(head, digits) THEN 'stale' ELSE 'current' END AS state FROM p""")
def graph_freshness(spark, sf):
    key = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", F.expr("substring(sha2(p_name, 256), 1, cast(4 + p_partkey % 9 as int))").alias("made"), F.when(key % 3 == 0, F.sha2("p_brand", 256)).otherwise(F.sha2("p_name", 256)).alias("head"), F.when(key % 7 != 0, key % 5 == 0).alias("dirty"))
    return p.select("p_partkey", graph.freshness(F.col("made"), F.col("head"), F.col("dirty")).alias("state"))


_RAW = ["-1", "1e6", "1e7", "true", "NaN", '"0.5"', "0.125", "12abc"]


@query(f"""WITH r AS (SELECT p_partkey, p_size, {_sql(_RAW, "p_partkey")} AS raw FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.25 WHEN raw IN ('-1', '1e6', '0.125') THEN CAST(raw AS DOUBLE) END AS value FROM r""")
def cohesion_values(spark, sf):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".25"))).otherwise(_pick(_RAW, F.col("p_partkey")))
    return table(spark, sf, "part").select("p_partkey", graph.usable_cohesion(raw).alias("value"))


# Imports with relative paths.

_PY = """p AS (SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS brand, p_partkey AS k FROM part),
f AS (SELECT DISTINCT brand || '/sub/part_' || k % 5 || '.py' AS path, unnest(['..base', '.', '..gone', 'os']) AS spec, brand FROM p)"""


@query(f"""WITH {_PY} SELECT path, spec, CASE spec WHEN '..base' THEN brand WHEN '.' THEN brand || '/sub' END AS target, CASE spec WHEN 'os' THEN 'os' END AS external FROM f""")
def relative_imports(spark, sf):
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")
    part = table(spark, sf, "part").select(brand.alias("brand"), "p_partkey")
    own = part.select(F.concat("brand", F.lit("/sub/part_"), (F.col("p_partkey") % 5).cast("string"), F.lit(".py")).alias("path")).distinct().withColumn("text", F.lit("from ..base import b\nfrom . import c\nfrom ..gone import d\nimport os\n"))
    base = part.select(F.concat("brand", F.lit("/base.py")).alias("path"), F.lit("x = 1\n").alias("text")).distinct()
    files = own.union(base).withColumn("language", F.lit("python"))
    return imports.resolve(imports.import_specs(files), files).select("path", "spec", "target", "external")


# Glossaries and findings.


@query(f"""WITH g AS (SELECT p_partkey, {_sql(list(glossaries.STATUSES), "p_size")} AS status, CASE WHEN p_partkey % 3 = 0 THEN {_sql(list(glossaries.STATUSES), "p_partkey")} END AS other FROM part)
SELECT status, sum(concepts)::BIGINT AS concepts, sum(aliases)::BIGINT AS aliases FROM (SELECT status, count(*) AS concepts, 0 AS aliases FROM g GROUP BY 1 UNION ALL SELECT other, 0, count(*) FROM g WHERE other IS NOT NULL GROUP BY 1) GROUP BY status""")
def status_counts(spark, sf):
    alias = F.array(F.struct(F.lit("old").alias("term"), _pick(list(glossaries.STATUSES), F.col("p_partkey")).alias("status"), F.lit(None).cast("string").alias("note")))
    g = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), _pick(list(glossaries.STATUSES), F.col("p_size")).alias("status"), F.when(F.col("p_partkey") % 3 == 0, alias).otherwise(F.array().cast("array<struct<term:string,status:string,note:string>>")).alias("aliases"))
    return completeness.status_counts(g)


_OWN_BIND, _OWN_STR = _BIND.replace(_values() + ",", ""), _STR.replace(_values() + ",", "")
_ALL = f"""{IDENT}, {DOC}, {_USES}, {_OWN_BIND}, {_GRAPH.replace("links AS", "glinks AS").replace("FROM links", "FROM glinks")}, {_OWN_STR}, found AS (
  SELECT 'watched-term-in-use' AS kind, concept || ':' || term AS subject, uses::DOUBLE AS value FROM totals WHERE status IN ('discouraged', 'deprecated') AND uses > 0
  UNION ALL SELECT 'fragmentation', concept, modules::DOUBLE FROM totals WHERE status = 'canonical' AND modules >= 5
  UNION ALL SELECT 'orphaned-concept', concept, uses::DOUBLE FROM totals WHERE status = 'canonical' AND len(toks) > 0 AND uses <= 2 AND concept NOT IN (SELECT concept FROM bind WHERE state IN ('resolved', 'uncertain'))
  UNION ALL SELECT 'binding-' || state, concept || ':' || ref, NULL FROM bind WHERE state IN ('unresolved', 'out-of-scope')
  UNION ALL SELECT 'unnamed-structure', "group", size::DOUBLE FROM gs WHERE "group" NOT IN (SELECT "group" FROM st)
  UNION ALL SELECT 'boundary-mismatch', x."group" || ':' || x.concept || ':' || y.concept, NULL FROM st x JOIN st y ON x."group" = y."group" AND x.concept < y.concept WHERE x.strength >= 2 AND y.strength >= 2
  UNION ALL SELECT 'overloaded-structural-region', "group", count(*)::DOUBLE FROM st WHERE strength >= 2 GROUP BY "group" HAVING count(*) >= 3)"""


def _found(spark, sf) -> DataFrame:
    g = _glossary(spark, sf).keep()
    states, strengths, summary = map(cut, (_states(g), *_strengths(spark, sf)))
    parts = [checks.watched_in_use(g), checks.fragmentation(g), checks.orphaned_concepts(g, states), checks.binding_findings(states, g), *checks.structural(strengths, summary).values()]
    return cut(reduce(DataFrame.unionByName, parts).select(*PLAIN, "scope"))


@query(f"""WITH {_ALL}, r AS (SELECT *, count(*) OVER (PARTITION BY kind) AS total, row_number() OVER (PARTITION BY kind ORDER BY value DESC NULLS LAST, subject) AS r FROM found) SELECT kind, subject, value, total FROM r WHERE r <= 10""")
def capped_findings(spark, sf):
    return checks.capped(_found(spark, sf)).select("kind", "subject", "value", "total")


_CAUSE, _CAP = "corpus: 3 file(s) or folder(s) left out: too-large", "the cap is 10 findings"


@query(f"""WITH {_ALL}, n AS (SELECT kind, count(*) AS total FROM found GROUP BY kind), kinds AS (SELECT unnest([{", ".join(_quoted(k) for k in completeness.VALIDATION)}]) AS kind)
SELECT kind, coalesce(total, 0) AS total, least(coalesce(total, 0), 10) AS included, greatest(coalesce(total, 0) - 10, 0) AS dropped, concat('{_CAUSE}', CASE WHEN total > 10 THEN '|{_CAP}' ELSE '' END) AS reasons FROM kinds LEFT JOIN n USING (kind)""")
def finding_sections(spark, sf):
    """A section a kind, found or not, of a corpus that isn't whole."""
    planned = completeness.plan(completeness.VALIDATION, completeness.corpus_reasons({"too-large": 3}), [], "ok", [], 0)
    got = completeness.sections(_found(spark, sf), planned)
    return got.select("kind", "total", "included", "dropped", F.array_join("reasons", "|").alias("reasons"))


