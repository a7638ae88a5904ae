"""The evidence of a repository: all tables of one scan, and the document made of their tops."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import LIMITS
from ..functions import lexical, paths
from ..functions.paths import name_of
from ..operators import graph, imports, inventory, matching, naming, terminology, topk, vocabulary
from ..sources import git, graphs, repository
from ..sources.cache import KEYS, ExtractionCache
from ..sources.shared import cut, together
from . import checks, completeness, glossaries

#: Names of each kind that are put forward.
NAMES = {"terms": 15, "modules": 10, "structures": 10}
#: Files that may hold a managed block, and the texts its marker lines start with.
HOSTS, BEGIN, END = ("AGENTS.md", "CLAUDE.md"), "<!-- lexiloom:begin", "<!-- lexiloom:end -->"


@dataclass
class Structure:
    """A graph's tables, or why there are none: disabled, absent, a state of the file, too-much-work or unusable."""

    state: str
    nodes: DataFrame | None = None
    links: DataFrame | None = None
    members: DataFrame | None = None
    labels: DataFrame | None = None
    cohesion: DataFrame | None = None
    commit: str | None = None


@dataclass
class Evidence:
    classified: DataFrame
    files: DataFrame
    ident_occ: DataFrame
    tok_occ: DataFrame
    doc_occ: DataFrame
    resolved: DataFrame
    root: str
    structure: Structure

    def token_counts(self) -> DataFrame:
        return vocabulary.token_counts(self.tok_occ)

    def doc_counts(self) -> DataFrame:
        return vocabulary.doc_vocabulary(self.doc_occ)


def read_structure(spark: SparkSession, path: str | None) -> Structure:
    """The graph in a JSON document, read in pieces; its work is judged from list lengths before anything is exploded, and from its labels before any is split."""
    if path is None:
        return Structure("disabled")
    state, text = graphs.read_graph(path)
    if text is None:
        return Structure(state)
    if not text.counts.get("nodes"):
        return Structure("unusable")
    if text.refs > LIMITS["graph_refs"]:
        return Structure("too-much-work")
    pieces = cut(text.frame(spark))
    nodes, links, groups = map(cut, graph.graph_tables(graphs.elements(pieces, "nodes"), graphs.elements(pieces, "links", "edges"), graphs.elements(pieces, "communities")))
    if nodes.isEmpty():
        return Structure("unusable")
    if graph.label_characters(nodes) > LIMITS["graph_label_chars"]:
        return Structure("too-much-work")
    explicit = not groups.isEmpty()
    members = graph.memberships(nodes, groups if explicit else None)
    labels, cohesion = graph.group_labels(nodes).select("group", "label"), members.select("group").distinct().withColumn("cohesion", F.lit(None).cast("double"))
    if explicit:
        named = groups.where("id is not null").groupBy(F.col("id").alias("group")).agg(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("pos"))).alias("own"), F.max("cohesion").alias("cohesion"))
        labels = named.join(labels, "group", "left").select("group", F.coalesce("own", "label").alias("label")).where("label is not null")
        cohesion = named.select("group", "cohesion")
    commit = text.values.get("built_at_commit")
    return Structure("ok", nodes, graph.visible_links(links, nodes), cut(members), labels, cohesion, commit if isinstance(commit, str) else None)


def extract(files: DataFrame, cache: ExtractionCache) -> tuple[DataFrame, DataFrame]:
    """(ident_occ, doc_occ): files whose content is known are read from the cache, the others split and added to it."""
    known = cache.read().dropDuplicates(KEYS)
    missing = files.join(known, KEYS, "left_anti")
    code = vocabulary.code_occurrences(missing.where("kind = 'code'")).select("path", F.col("name").alias("word"), "n")
    words = code.union(vocabulary.doc_occurrences(missing.where("kind = 'doc'")).select("path", "term", "n"))
    found = words.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("found"))  # at most one file's words
    none = F.array().cast("array<struct<word:string,n:long>>")
    fresh = cut(missing.select(*KEYS).join(found, "path", "left").select(*KEYS, F.coalesce("found", none).alias("found")))
    if not fresh.isEmpty():
        cache.add(fresh)
    rows = files.select(*KEYS, "module", "language").join(known.unionByName(fresh), KEYS).select("path", "kind", "module", "language", F.inline("found"))
    return rows.where("kind = 'code'").select(F.col("word").alias("name"), "path", "module", "language", "n"), rows.where("kind = 'doc'").select(F.col("word").alias("term"), "path", "n")


def scan(spark: SparkSession, root: str, config: repository.Config | None = None, cache: ExtractionCache | None = None, graph_path: str | None = None) -> Evidence:
    """Lists, reads and splits a repository; only production files feed the vocabulary.

    The managed block of an instruction file is no evidence: it echoes the glossary.
    """
    classified = cut(repository.classify(spark, root, config))
    host = F.lower(name_of(F.col("path"))).isin([h.lower() for h in HOSTS])
    texts = repository.read_texts(classified, root)
    stripped = F.when(host, repository.strip_block(F.col("text"), BEGIN, END)).otherwise(F.col("text"))
    files = cut(texts.withColumn("text", stripped))
    unread = files.where("problem is not null").select("path", "problem")
    if unread.head(1):  # what couldn't be read is no part of the corpus after all
        classified = cut(classified.join(unread, "path", "left").withColumn("exclusion_kind", F.coalesce("exclusion_kind", F.when(F.col("problem").isNotNull(), "unreadable"))).drop("problem"))
    good = files.where("problem is null and role = 'production'")
    code = good.where("kind = 'code'")
    occ, doc = extract(good, cache) if cache else (vocabulary.code_occurrences(code), vocabulary.doc_occurrences(good.where("kind = 'doc'")))

    def words() -> tuple[DataFrame, DataFrame]:
        names = cut(occ)
        return names, cut(vocabulary.token_occurrences(names))

    got = together(spark, words=words, resolved=lambda: cut(imports.resolve(imports.import_specs(code), code)), doc=lambda: cut(doc), structure=lambda: read_structure(spark, graph_path))
    return Evidence(classified, files, *got["words"], got["doc"], got["resolved"], root, got["structure"])


def markdown_glossary(root: str) -> tuple[dict, str | None]:
    """({state, bytes, sha256}, text) of the root's GLOSSARY.md, followed only inside the root."""
    path = os.path.join(root, "GLOSSARY.md")
    info: dict = {"state": "absent", "bytes": None, "sha256": None}
    if not os.path.lexists(path) or repository.named_exactly(root, "GLOSSARY.md") is False:
        return info, None
    real, inside = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([real, inside]) != inside:
        return info | {"state": "symlink-escapes"}, None
    try:
        with open(real, "rb") as f:
            raw = f.read(LIMITS["file_bytes"] + 1)
    except OSError:
        return info | {"state": "unreadable"}, None
    if len(raw) > LIMITS["file_bytes"]:
        return info | {"state": "oversized"}, None
    info |= {"bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}
    try:
        return info | {"state": "ok"}, raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return info | {"state": "not-utf-8"}, None


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # only capped tables come here


def document(e: Evidence, root: str) -> dict:
    """The tops of every table with their coverage; the whole tables stay DataFrames."""
    spark = e.files.sparkSession
    read = lexical.normalize_text(e.files.where("problem is null").select("module", "role", "kind", "language", "size", F.when(F.col("kind") == "doc", F.col("text")).alias("text")), "text", form="FOLD")
    words = F.when(F.col("kind") == "doc", F.size(lexical.doc_words(F.col("text"))))
    counts = together(spark, tokens=lambda: cut(e.token_counts()), docs=lambda: cut(e.doc_counts()), edges=lambda: cut(imports.internal_edges(e.resolved)), made=lambda: cut(inventory.inventory(read.withColumn("words", words))))
    tc, dc, edges, made = counts["tokens"], counts["docs"], counts["edges"], counts["made"]
    mods = inventory.module_inventory(made)

    def section(df: DataFrame, k: int, *order, key: str | None = None, uses: DataFrame | None = None) -> dict:
        """The top with its ledger; ``uses(key, path, module, n)`` adds the places and the uses a module of what is kept."""
        top, led = topk.top_k_with_ledger(df, k, *order)
        if key is None:
            return {"items": _rows(top), "coverage": led}
        return {"items": _rows(located(top, key, uses).orderBy(*order)), "coverage": led}

    def located(top: DataFrame, key: str, uses: DataFrame) -> DataFrame:
        own = cut(uses.join(top.select(key), key, "left_semi"))
        places = topk.locations(own.select(key, "path", "n"), key, LIMITS["locations"])
        modules = completeness.rollup(own.select(F.col(key).alias("key"), "module", "path", "n"))
        most = topk.per_key(modules, ["key"], LIMITS["locations"], F.desc("uses"), F.asc("module")).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", "uses")))).alias("uses_by_module"))
        return top.join(places, key, "left").join(most.withColumnRenamed("key", key), key, "left")

    by_token = vocabulary.by_token(e.tok_occ).select("token", "path", "module", "n")
    prose = e.doc_occ.withColumn("module", paths.module_of(F.col("path")))

    def structure() -> dict:
        s = e.structure
        if s.state != "ok":
            return {"state": s.state}
        groups = graph.group_summary(s.members, s.nodes).join(s.labels, "group", "left").join(graph.member_samples(s.members, s.nodes, graph.node_degrees(s.links)), "group", "left")
        tokens, over = graph.member_tokens(s.members, s.nodes)
        first = tokens.groupBy("group").agg(F.array_sort(F.collect_list("token")).alias("member_tokens"))  # at most the cap of a group
        groups = groups.join(first, "group", "left").join(over.select("group", F.col("dropped").alias("member_tokens_dropped")), "group", "left").na.fill(0, ["member_tokens_dropped"])
        stamp = git.git_stamp(root)
        fresh = spark.range(1).select(graph.freshness(*[F.lit(v).cast(t) for v, t in ((s.commit, "string"), (stamp["head"], "string"), (stamp["dirty"], "boolean"))])).head()[0]
        files = cut(git.file_freshness(s.nodes, root, s.commit))
        by_state = {r["state"]: r["files"] for r in files.groupBy("state").agg(F.count("*").alias("files")).collect()}
        stale = _rows(topk.top_k(files.where("state != 'current'"), LIMITS["findings"], F.desc("nodes"), F.asc("source_file")))
        groups = cut(groups)
        kept = topk.top_k(groups, LIMITS["groups"], F.desc("size"), F.asc("group"))
        # Two things keep a group from being named: the cap of groups, and that of names.
        every, held = groups.where("size >= 2").count(), kept.where("size >= 2").count()
        named = min(held, NAMES["structures"])
        why = ([f"the cap is {NAMES['structures']} names of groups"] if held > named else []) + ([f"{every - held} group(s) of two or more members beyond the cap of groups"] if every > held else [])
        names = _rows(graph.structure_scores(kept, s.cohesion, NAMES["structures"]))
        return {"state": "ok", "freshness": fresh, "files": by_state, "stale_files": stale, "groups": section(groups, LIMITS["groups"], F.desc("size"), F.asc("group")), "god_nodes": _rows(graph.god_nodes(graph.node_degrees(s.links))), "naming": names, "naming_coverage": topk.ledger(every, named, True, why)}

    def layout() -> dict:
        declared, found = repository.declared_workspaces(e.classified, root), _rows(repository.monorepo(e.classified))[0]
        return found | {"workspaces": declared, "monorepo": bool(found["monorepo"] or declared)}

    def markdown() -> dict:
        nested = e.classified.where("exclusion_kind = 'own-output'").where(F.col("path").endswith("/GLOSSARY.md")).select("path").orderBy("path").limit(LIMITS["findings"])
        return markdown_glossary(root)[0] | {"nested": [r["path"] for r in nested.collect()]}

    def register() -> dict:
        reg = cut(terminology.register(e.tok_occ, dc))
        shares = terminology.style_shares(reg).orderBy(F.desc("spellings"), "style")
        return {"styles": _rows(shares), "prefixes": _rows(terminology.affixes(reg, "prefix")), "suffixes": _rows(terminology.affixes(reg, "suffix"))}

    def contexts() -> dict:
        disp = cut(terminology.context_dispersion(e.tok_occ, tc))
        terms = located(naming.term_scores(e.tok_occ, tc, dc, disp), "term", by_token.withColumnRenamed("token", "term")).orderBy(F.desc("score"), "term")
        return together(spark, dispersion=lambda: _rows(disp.orderBy("term")), overloads=lambda: _rows(terminology.overload_candidates(disp)), terms=lambda: _rows(terms))

    def pools() -> dict:
        """How many terms and modules could have been named, and what left others out."""
        t = tc.agg(F.count_if((F.col("origin") == "domain") & (F.col("modules") >= 2)).alias("terms"), F.count_if(F.col("origin") == "language").alias("language")).head()
        targets, pairs, whole = edges.where("dst != '.'").select("dst").distinct().count(), edges.count(), imports.internal_edges(e.resolved, cap=None).count()
        capped = lambda n, what: [f"the cap is {NAMES[what]} names of {what}"] if n > NAMES[what] else []
        return {
            "terms": topk.ledger(t["terms"], min(t["terms"], NAMES["terms"]), True, capped(t["terms"], "terms") + ([f"{t['language']} token(s) of a language left out"] if t["language"] else [])),
            "modules": topk.ledger(targets, min(targets, NAMES["modules"]), whole == pairs, capped(targets, "modules") + ([f"{whole - pairs} import edge(s) beyond the cap of edges"] if whole > pairs else [])),
        }

    # The longest go first.
    got = together(
        spark,
        contexts=contexts,
        synonyms=lambda: _rows(terminology.synonym_candidates(e.tok_occ, tc)),
        tokens=lambda: section(tc, LIMITS["tokens"], F.desc("uses"), F.asc("token"), key="token", uses=by_token),
        identifiers=lambda: section(vocabulary.identifier_counts(e.ident_occ), LIMITS["identifiers"], F.desc("uses"), F.asc("name"), key="name", uses=e.ident_occ.select("name", "path", "module", "n")),
        doc_terms=lambda: section(dc, LIMITS["doc_terms"], F.desc("uses"), F.asc("term"), key="term", uses=prose),
        register=register,
        structure=structure,
        modules_named=lambda: _rows(naming.module_scores(edges, mods, dc)),
        shared=lambda: _rows(terminology.layers(tc, dc, "shared")),
        code_only=lambda: _rows(terminology.layers(tc, dc, "code_only")),
        doc_only=lambda: _rows(terminology.layers(tc, dc, "doc_only")),
        layout=layout,
        markdown=markdown,
        exclusions=lambda: _rows(repository.exclusion_ledger(e.classified).orderBy("exclusion_kind")),
        totals=lambda: _rows(inventory.totals(made))[0],
        languages=lambda: {r["language"]: r["files"] for r in made.where("level = 'language' and kind = 'code' and language is not null").select("language", "files").orderBy("language").collect()},
        modules=lambda: _rows(mods.orderBy("module").limit(LIMITS["source_files"])),
        edges=lambda: _rows(edges),
        external=lambda: _rows(imports.external_tally(e.resolved)),
        git=lambda: git.git_stamp(root),
        pools=pools,
    )
    return {
        "schema_version": 1,
        "layout": got["layout"],
        "markdown_glossary": got["markdown"],
        **{k: got[k] for k in ("structure", "git", "exclusions", "totals", "languages", "modules", "tokens", "identifiers", "doc_terms", "register")},
        "layers": {k: got[k] for k in ("shared", "code_only", "doc_only")},
        "synonyms": got["synonyms"],
        "dispersion": got["contexts"]["dispersion"],
        "overloads": got["contexts"]["overloads"],
        "imports": {"edges": got["edges"], "external": got["external"]},
        "naming": {"modules": got["modules_named"], "terms": got["contexts"]["terms"], "coverage": got["pools"]},
        "tokenization": lexical.tokenization_contract(),
    }


@dataclass
class Held:
    """A glossary against the evidence, with the tables that the checks share."""

    g: checks.Glossary
    synonyms: DataFrame
    dispersion: DataFrame

    def drift(self) -> DataFrame:
        return checks.drift(self.g, self.synonyms, self.dispersion)


def _held(spark: SparkSession, e: Evidence, glossary: dict) -> Held:
    counts = together(spark, tokens=lambda: cut(e.token_counts()), docs=lambda: cut(e.doc_counts()))
    tc, g = counts["tokens"], checks.Glossary(glossaries.to_frame(spark, glossary), e.tok_occ, counts["docs"])
    uses = g.uses
    got = together(spark, uses=lambda: cut(uses), synonyms=lambda: cut(terminology.synonym_candidates(e.tok_occ, tc)), contexts=lambda: cut(terminology.context_dispersion(e.tok_occ, tc)))
    g.uses = got["uses"]
    g.totals = cut(matching.occurrence_totals(g.terms, g.uses))
    return Held(g, got["synonyms"], got["contexts"])


def _divergence(g: checks.Glossary, root: str) -> list[DataFrame]:
    """Findings about the root's Markdown glossary, if it can be read."""
    text = markdown_glossary(root)[1]
    if text is None:
        return []
    return [checks.divergence_findings(matching.markdown_divergence(g.rows, text)[0])]


def _exclusions(e: Evidence) -> dict[str, int]:
    """Files by kind of exclusion, those that couldn't be read among them."""
    return {r[0]: r[1] for r in e.classified.where("exclusion_kind is not null").groupBy("exclusion_kind").count().collect()}


def findings(spark: SparkSession, e: Evidence, glossary: dict, which: str) -> dict:
    """{findings, sections, complete, limitations} of ``which``: drift or validation. Every kind has a section, found or not."""
    own = _held(spark, e, glossary)
    rows = cut((drift if which == "drift" else validation)(spark, e, glossary, own))
    scoped = checks.scoped_dispersion(own.g, terminology.overload_candidates(own.dispersion))
    narrow = sum(c["status"] == "canonical" and "scope" in c for c in glossary["concepts"])
    groups = graph.group_summary(e.structure.members, e.structure.nodes).count() if e.structure.state == "ok" else 0
    kinds = completeness.DRIFT if which == "drift" else completeness.VALIDATION
    corpus = completeness.corpus_reasons(_exclusions(e))
    planned = completeness.plan(kinds, corpus, completeness.overload_reasons(scoped), e.structure.state, completeness.graph_reasons(groups), narrow)
    totals = {r["kind"]: r["total"] for r in rows.select("kind", "total").distinct().collect()}
    withheld = completeness.withhold(planned, totals, corpus)
    rows = rows.where(~F.col("kind").isin(list(withheld)))
    held = _rows(completeness.sections(rows, planned, totals=totals).orderBy("kind"))
    skipped = [s["kind"] for s in held if s["skipped"]]
    kept = _rows(rows.where(~F.col("kind").isin(skipped)).orderBy("kind", "subject"))
    return {"findings": kept, "sections": held, "complete": all(s["complete"] for s in held if not s["skipped"]) and not any(s["skipped"] for s in held), "withheld": withheld, "limitations": completeness.limitations(held), "glossary_sha256": glossaries.digest(glossary)}


def drift(spark: SparkSession, e: Evidence, glossary: dict, own: Held | None = None) -> DataFrame:
    own = own or _held(spark, e, glossary)
    found = own.drift()
    for more in _divergence(own.g, e.root):
        found = found.unionByName(more)
    return checks.capped(found)


def validation(spark: SparkSession, e: Evidence, glossary: dict, own: Held | None = None) -> DataFrame:
    """Bindings, orphans, fragmentation and drift, and the structural checks where the evidence has a graph."""
    own = own or _held(spark, e, glossary)
    g, drifted = own.g, own.drift()
    excluded = e.classified.where(F.col("exclusion_kind").isin(list(completeness.EXCLUDED_KINDS))).select("path")
    whole = not completeness.corpus_reasons(_exclusions(e))
    states, s = cut(checks.bindings(g, e.files.where("problem is null").select("path"), excluded, whole, e.root)), e.structure
    found = [drifted, checks.orphaned_concepts(g, states), checks.binding_findings(states, g), checks.fragmentation(g)]
    if s.state == "ok":
        found += checks.structural(cut(checks.strengths(g, s.nodes, s.members, s.labels)), graph.group_summary(s.members, s.nodes), graph.member_samples(s.members, s.nodes, graph.node_degrees(s.links))).values()
    return checks.capped(reduce(DataFrame.unionByName, found))


def brief(glossary: dict, budget: int = 4096, entry: int = 1024) -> str:
    """Canonical terms as text within a byte budget; a footer tells how many are left out."""
    terms = sorted((c for c in glossary["concepts"] if c["status"] == "canonical"), key=lambda c: (c["term"].casefold(), c["term"], c["id"]))
    lines: list[str] = []
    room = budget - len(f"({len(terms)} of {len(terms)} terms)\n")
    for c in terms:
        aliases = ", ".join(sorted(a["term"] for a in c.get("aliases") or []))
        line = shorten(f"- {c['term']}: {c['definition']}" + (f" (not: {aliases})" if aliases else ""), entry) + "\n"
        if len(line.encode()) > room:
            break
        room -= len(line.encode())
        lines.append(line)
    return "".join(lines) + f"({len(lines)} of {len(terms)} terms)\n"


def shorten(text: str, most: int) -> str:
    """At most ``most`` bytes of UTF-8, whole characters, with an ellipsis if cut."""
    raw = text.encode()
    return text if len(raw) <= most else raw[: most - 3].decode(errors="ignore") + "…"
