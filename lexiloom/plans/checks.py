"""Drift and validation: a glossary held against the evidence. Each check is a table of findings."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.fixed import LIMITS
from ..functions.paths import in_scope, module_of, scopes_overlap
from ..operators import graph, matching, vocabulary
from ..operators.terminology import DIVERGENT, LEAST_MODULES
from ..operators import topk
from ..operators.topk import per_key
from ..sources.shared import cut
from . import glossaries

STRONG, MODERATE = 0.7, 0.55


_PLACES = "array<struct<path:string,count:bigint>>"
#: What findings may carry; each kind fills its own fields, the others are null.
EVIDENCE = {
    "similarity": "double", "shared_contexts": "array<string>", "count": "bigint", "files": "bigint", "modules": "bigint", "locations": _PLACES, "locations_truncated": "boolean",
    "canonical_count": "bigint", "canonical_locations": _PLACES, "doc_mentions": "bigint", "dispersion": "double", "module_contexts": "array<struct<module:string,uses:bigint,contexts:array<string>>>",
    "size": "bigint", "members": "array<string>", "concepts": "array<string>", "bindings_resolved": "bigint", "bindings_total": "bigint", "ref": "string", "binding_status": "string",
}


def finding(kind: str, subject: Column, summary: Column, signal: Column | None = None, certainty: str | None = None, value: Column | None = None, scope: Column | None = None, **evidence: Column) -> list[Column]:
    """The columns of every finding: exactly one of certainty and signal_strength is set; ``summary`` is a sentence, ``scope`` the prefixes it holds in (null: everywhere), ``evidence`` a struct of ``EVIDENCE``."""
    if (signal is None) == (certainty is None):
        raise ValueError("a finding has either a signal strength or a certainty")
    if unknown := set(evidence) - set(EVIDENCE):
        raise ValueError(f"no such evidence: {sorted(unknown)}")
    null = F.lit(None)
    held = F.struct(*[evidence.get(name, null).cast(kind_).alias(name) for name, kind_ in EVIDENCE.items()])
    return [
        F.lit(kind).alias("kind"), subject.alias("subject"), (signal if signal is not None else null).cast("string").alias("signal_strength"), F.lit(certainty).cast("string").alias("certainty"),
        (value if value is not None else null).cast("double").alias("value"), (scope if scope is not None else null).cast("array<string>").alias("scope"), held.alias("evidence"), summary.alias("summary"),
    ]


def _said(template: str, *columns: str) -> Column:
    """A sentence with columns in the places of ``{}``; a null is an empty text."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for part, c in zip(parts[1:], columns, strict=True):
        out += [F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(part)]
    return F.concat(*out)


class Glossary:
    """A glossary with its terms split once, and its uses in the evidence."""

    def __init__(self, glossary: DataFrame, tok_occ: DataFrame, doc_counts: DataFrame, ident_counts: DataFrame | None = None):
        self.rows, self.tok_occ, self.doc_counts, self.ident_counts = glossary, tok_occ, doc_counts, ident_counts
        self.scopes = glossary.select(F.col("id").alias("concept"), "prefixes")
        self.terms = matching.term_tokens(glossaries.all_terms(glossary))
        self.canonical = self.terms.join(glossary.where("status = 'canonical'").select(F.col("id").alias("concept"), F.col("term").alias("own")), "concept").where("term = own").drop("own")
        self.uses = matching.occurrences(self.terms, tok_occ, self.scopes)
        self.totals = matching.occurrence_totals(self.terms, self.uses)
        self._held: DataFrame | None = None

    def keep(self) -> Glossary:
        """Itself with identifiers, uses and ``occurrence`` written once, for several checks of one glossary."""
        self.tok_occ = cut(self.tok_occ)
        uses = matching.occurrences(self.terms, self.tok_occ, self.scopes)
        self.uses = cut(uses.groupBy("concept", "term", "name", "path", "module").agg(F.sum("n").alias("n")))
        self.totals = cut(matching.occurrence_totals(self.terms, self.uses))
        self._held = cut(self.occurrence())
        return self

    def occurrence(self) -> DataFrame:
        """(concept, term, uses, files, modules, locations, locations_truncated, prefixes) for every term, zeros included: a term's uses with their places."""
        if self._held is not None:
            return self._held
        key = F.to_json(F.array("concept", "term"))
        places = topk.locations(self.uses.select(key.alias("key"), "path", "n"), "key", LIMITS["locations"])
        got = self.totals.withColumn("key", key).join(places, "key", "left").drop("key").join(self.scopes, "concept")
        return got.withColumn("locations", F.coalesce("locations", F.array().cast(_PLACES))).withColumn("locations_truncated", F.coalesce("locations_truncated", F.lit(False)))

    def index(self) -> DataFrame:
        """(token, concept, prefixes): canonical terms of a single token."""
        return self.canonical.where(F.size("tokens") == 1).select(F.element_at("tokens", 1).alias("token"), "concept").join(self.scopes, "concept")


def parallel_terms(g: Glossary, synonyms: DataFrame) -> DataFrame:
    """A synonym pair of which exactly one side is a canonical term, where both occur in the concept's scope and the other isn't owned in it."""
    idx = g.index()
    side = lambda t, c: synonyms.join(idx.select(F.col("token").alias(t), F.col("concept").alias(c), F.col("prefixes").alias(f"p{c}")), t, "left").select("a", "b", "similarity", "contexts", c, f"p{c}")
    both = side("a", "ca").join(side("b", "cb").drop("similarity", "contexts"), ["a", "b"]).where("(ca is null) != (cb is null)")
    rows = both.select(F.when(F.col("ca").isNull(), F.col("a")).otherwise(F.col("b")).alias("new"), F.coalesce("ca", "cb").alias("concept"), F.coalesce("pca", "pcb").alias("prefixes"), "similarity", "contexts")
    owned = g.terms.select("concept", F.explode("tokens").alias("new")).join(g.scopes.withColumnRenamed("prefixes", "owner"), "concept").select("new", "owner")
    taken = rows.join(owned, "new").where(scopes_overlap(F.col("prefixes"), F.col("owner"))).select("new", "concept").distinct()
    rows = rows.join(taken, ["new", "concept"], "left_anti")
    places = vocabulary.by_token(g.tok_occ).select(F.col("token").alias("new"), "path", "n")
    met = places.join(rows.select("new", "concept", "prefixes").distinct(), "new").where(in_scope(F.col("path"), F.col("prefixes")))
    key = F.to_json(F.array("concept", "new"))
    new = topk.locations(met.select(key.alias("key"), "path", "n"), "key", LIMITS["locations"]).join(met.groupBy(key.alias("key"), "concept", "new").agg(F.sum("n").alias("count"), F.countDistinct("path").alias("files")), "key").drop("key")
    own = g.canonical.where(F.size("tokens") == 1).select("concept", "term").join(g.occurrence().drop("prefixes", "files"), ["concept", "term"]).where("uses > 0").select("concept", "term", F.col("uses").alias("canonical_count"), F.col("locations").alias("canonical_locations"))
    rows = rows.join(own, "concept").join(new, ["new", "concept"])
    strength = F.when(F.col("similarity") >= STRONG, "strong").when(F.col("similarity") >= MODERATE, "moderate").otherwise("weak")
    return rows.select(*finding(
        "parallel-term", F.concat_ws(":", "concept", "new"), _said("'{}' is used like the canonical '{}' (similarity {})", "new", "term", "similarity"), signal=strength, value=F.col("similarity"), scope=F.col("prefixes"),
        similarity=F.col("similarity"), shared_contexts=F.split("contexts", " "), count=F.col("count"), files=F.col("files"), locations=F.col("locations"), locations_truncated=F.col("locations_truncated"), canonical_count=F.col("canonical_count"), canonical_locations=F.col("canonical_locations"),
    ))


def _uses() -> dict[str, Column]:
    """The evidence of an ``occurrence`` row."""
    return {"count": F.col("uses")} | {c: F.col(c) for c in ("files", "modules", "locations", "locations_truncated")}


def watched_in_use(g: Glossary) -> DataFrame:
    rows = g.terms.where(F.col("status").isin("discouraged", "deprecated")).select("concept", "term", "status").join(g.occurrence().where("uses > 0"), ["concept", "term"])
    return rows.select(*finding("watched-term-in-use", F.concat_ws(":", "concept", "term"), _said("the {} '{}' is still used {} time(s) in {} file(s)", "status", "term", "uses", "files"), certainty="observed", value=F.col("uses"), scope=F.col("prefixes"), **_uses()))


def canonical_fading(g: Glossary) -> DataFrame:
    """Canonical terms without a use: strong; with one or two and none in prose: moderate."""
    docs = matching.doc_occurrence(g.canonical, g.doc_counts)
    rows = g.canonical.select("concept", "term").join(g.occurrence(), ["concept", "term"]).join(docs, ["concept", "term"])
    signal = F.when(F.col("uses") == 0, "strong").when((F.col("uses") <= 2) & (F.col("doc_uses") == 0), "moderate")
    summary = F.when(F.col("uses") == 0, _said("the canonical '{}' isn't used in code", "term")).otherwise(_said("the canonical '{}' is used {} time(s) in code and not in prose", "term", "uses"))
    return rows.where(signal.isNotNull()).select(*finding("canonical-fading", F.concat_ws(":", "concept", "term"), summary, signal=signal, value=F.col("uses"), scope=F.col("prefixes"), doc_mentions=F.col("doc_uses"), **_uses()))


#: Modules and contexts of an overload candidate that its evidence holds in full.
SHOWN_MODULES, SHOWN_CONTEXTS = 4, 5


def scoped_dispersion(g: Glossary, dispersion: DataFrame, modules: int = SHOWN_MODULES, contexts: int = SHOWN_CONTEXTS) -> DataFrame:
    """(concept, term, whole, dispersion): divergent terms taken again over the modules in a scoped concept's scope.

    whole: the term has at most so many ``modules`` and ``contexts`` of each, so
    that the evidence holds them all; else nothing can be said. dispersion is null without LEAST_MODULES modules in scope.
    """
    wanted = g.index().where("prefixes is not null").join(dispersion.where("divergent").select(F.col("term").alias("token")), "token", "left_semi")
    near = vocabulary.neighbor_pairs(g.tok_occ, ["module"], wanted.select("token").distinct()).select(F.col("a").alias("token"), "module", "b")
    sets = near.groupBy("token", "module").agg(F.collect_set("b").alias("s"))
    whole = sets.groupBy("token").agg(((F.count("*") <= modules) & (F.max(F.size("s")) <= contexts)).alias("whole"))
    own = wanted.join(whole, "token")
    inside = own.where("whole").join(sets, "token").where(in_scope(F.col("module"), F.col("prefixes"))).select("concept", "token", "module", "s")
    two = inside.select("concept", F.col("module").alias("m2"), F.col("s").alias("s2"))
    jac = F.size(F.array_intersect("s", "s2")) / F.size(F.array_union("s", "s2"))
    # LEAST_MODULES modules make three pairs or more.
    again = inside.join(two, "concept").where("module < m2").groupBy("concept").agg(F.round(1 - F.avg(jac), 3).alias("dispersion"), F.count("*").alias("pairs"))
    return own.join(again.where(F.col("pairs") >= LEAST_MODULES * (LEAST_MODULES - 1) // 2), "concept", "left").select("concept", F.col("token").alias("term"), "whole", "dispersion")


def canonical_overloaded(g: Glossary, dispersion: DataFrame, modules: int = SHOWN_MODULES, contexts: int = SHOWN_CONTEXTS) -> DataFrame:
    """Canonical terms of divergent contexts, a scoped concept's over the modules in its scope."""
    rows = dispersion.where("divergent").join(g.index().where("prefixes is null"), F.col("term") == F.col("token")).select("concept", "token", "dispersion")
    rows = rows.union(scoped_dispersion(g, dispersion, modules, contexts).where(F.col("dispersion") >= DIVERGENT).select("concept", "term", "dispersion"))
    rows = rows.join(g.canonical.where(F.size("tokens") == 1).select("concept", "term"), "concept").join(g.scopes, "concept")
    # A concept's modules in its scope, with the first contexts of each.
    wanted = rows.select("concept", "token", "prefixes")
    uses = vocabulary.by_token(g.tok_occ).groupBy("token", "module").agg(F.sum("n").alias("uses")).join(wanted, "token").where(in_scope(F.col("module"), F.col("prefixes")))
    near = vocabulary.neighbor_pairs(g.tok_occ, ["module"], wanted.select("token").distinct()).select(F.col("a").alias("token"), "module", "b")
    first = per_key(near, ["token", "module"], SHOWN_CONTEXTS, F.asc("b")).groupBy("token", "module").agg(F.array_sort(F.collect_list("b")).alias("contexts"))
    counts = uses.groupBy("concept").agg(F.count("*").alias("modules"))
    shown = per_key(uses, ["concept"], SHOWN_MODULES, F.desc("uses"), F.asc("module")).join(first, ["token", "module"], "left").groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("rank", "module", "uses", "contexts"))).alias("all"))
    rows = rows.join(counts, "concept", "left").join(shown, "concept", "left").withColumn("module_contexts", F.transform("all", lambda x: F.struct(x["module"].alias("module"), x["uses"].alias("uses"), x["contexts"].alias("contexts"))))
    strength = F.when(F.col("dispersion") >= 0.95, "strong").otherwise("moderate")
    return rows.select(*finding("canonical-overloaded", F.concat_ws(":", "concept", "term"), _said("the canonical '{}' stands in unlike contexts over {} module(s)", "term", "modules"), signal=strength, value=F.col("dispersion"), scope=F.col("prefixes"), dispersion=F.col("dispersion"), modules=F.col("modules"), module_contexts=F.col("module_contexts")))


def exists_confined(root: str | None, relative: str) -> bool:
    """Whether a path names something inside ``root``; absolute paths, ``..`` and links that lead out read as absent."""
    if not root or not relative or os.path.isabs(relative) or ".." in relative.split("/"):
        return False
    top, at = os.path.realpath(root), os.path.realpath(os.path.join(root, relative))
    return os.path.exists(at) and (at == top or at.startswith(top + os.sep))


def bindings(g: Glossary, paths: DataFrame, excluded: Sequence[str] | DataFrame = (), complete: bool = True, root: str | None = None) -> DataFrame:
    """(concept, ref, state) for symbol:, file: and module: references: resolved, out-of-scope, uncertain or unresolved.

    ``paths(path)``: files the evidence knows; ``excluded``: paths, or a table of them. A file or module it doesn't know is
    uncertain if the inventory isn't complete, if it lies under an ``excluded``
    path, which was left unread, or if it exists inside ``root``.
    """
    # At most as many bindings as a glossary may hold are looked up on the driver's disk.
    refs = g.rows.select(F.col("id").alias("concept"), "prefixes", F.explode("bindings").alias("ref")).withColumn("what", F.regexp_extract("ref", "^([^:]*):", 1)).withColumn("key", F.regexp_replace("ref", "^[^:]*:", ""))
    refs = lexical.normalize_text(refs, "key", form="NFC")
    paths = lexical.normalize_text(paths.select("path"), "path", form="NFC")  # one spelling on every side
    held = excluded if isinstance(excluded, DataFrame) else paths.sparkSession.createDataFrame([(p,) for p in excluded], "path string")
    held = lexical.normalize_text(held.select("path"), "path", form="NFC")
    symbols = refs.where("what = 'symbol'").join(g.tok_occ.select(F.col("name").alias("key"), "path").distinct(), "key", "left").select("concept", "ref", "path", "prefixes", F.lit(False).alias("maybe"))
    known = paths.select(F.col("path").alias("key"), F.lit("file").alias("what")).union(paths.select(module_of(F.col("path")), F.lit("module"))).distinct()
    places = refs.where("what != 'symbol'").join(known.withColumn("path", F.col("key")), ["what", "key"], "left")
    if root:
        there = [(k["key"],) for k in refs.where("what != 'symbol'").select("key").distinct().collect() if exists_confined(root, k["key"])]
        held = held.select("path").union(paths.sparkSession.createDataFrame(there, "path string"))
    # A path meets what lies above it by equality with its own beginnings.
    steps = F.split("key", "/")
    heads = refs.where("what != 'symbol'").select("concept", "ref", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("head"))
    unread = heads.join(held.select(F.col("path").alias("head")).distinct(), "head").select("concept", "ref").distinct().withColumn("maybe", F.lit(True))
    places = places.join(unread, ["concept", "ref"], "left").select("concept", "ref", "path", "prefixes", (F.coalesce("maybe", F.lit(False)) | F.lit(not complete)).alias("maybe"))
    inside = F.col("path").isNotNull() & in_scope(F.col("path"), F.col("prefixes"))
    got = symbols.union(places).groupBy("concept", "ref").agg(F.max(F.col("path").isNotNull()).alias("there"), F.max(inside).alias("inside"), F.max("maybe").alias("maybe"))
    return got.select("concept", "ref", F.when(F.col("inside"), "resolved").when(F.col("there"), "out-of-scope").when(F.col("maybe"), "uncertain").otherwise("unresolved").alias("state"))


def binding_findings(states: DataFrame, g: Glossary | None = None) -> DataFrame:
    """Bindings that lead nowhere or out of the concept's scope."""
    rows = states.where("state in ('unresolved', 'out-of-scope')")
    rows = rows.join(g.scopes, "concept") if g else rows.withColumn("prefixes", F.lit(None).cast("array<string>"))
    summary = F.when(F.col("state") == "unresolved", _said("the binding {} of '{}' leads to nothing known", "ref", "concept")).otherwise(_said("the binding {} of '{}' leads out of its scope", "ref", "concept"))
    both = [rows.where(F.col("state") == state).select(*finding(f"binding-{state}", F.concat_ws(":", "concept", "ref"), summary, certainty="observed", scope=F.col("prefixes"), ref=F.col("ref"), binding_status=F.col("state"))) for state in ("unresolved", "out-of-scope")]
    return both[0].unionByName(both[1])


def orphaned_concepts(g: Glossary, states: DataFrame) -> DataFrame:
    """Canonical concepts with at most two uses in their scope and no binding that is resolved or uncertain."""
    bound = states.groupBy("concept").agg(F.count("*").alias("bindings_total"), F.count_if(F.col("state") == "resolved").alias("bindings_resolved"), F.count_if(F.col("state").isin("resolved", "uncertain")).alias("held"))
    rows = g.canonical.where(F.size("tokens") > 0).select("concept", "term").join(g.occurrence().where("uses <= 2"), ["concept", "term"]).join(bound, "concept", "left").where("coalesce(held, 0) = 0")
    signal = F.when(F.col("uses") == 0, "strong").otherwise("moderate")
    count = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(*finding("orphaned-concept", F.col("concept"), _said("the canonical '{}' has {} use(s) and no binding that holds", "term", "uses"), signal=signal, value=F.col("uses"), scope=F.col("prefixes"), bindings_total=count("bindings_total"), bindings_resolved=count("bindings_resolved"), **_uses()))


def fragmentation(g: Glossary, least: int = 5) -> DataFrame:
    rows = g.canonical.select("concept", "term").join(g.occurrence(), ["concept", "term"]).where(F.col("modules") >= least)
    return rows.select(*finding("fragmentation", F.col("concept"), _said("'{}' is spread over {} modules", "term", "modules"), signal=F.lit("weak"), value=F.col("modules"), scope=F.col("prefixes"), **_uses()))


def structural(strengths: DataFrame, summary: DataFrame, samples: DataFrame | None = None) -> dict[str, DataFrame]:
    """unnamed-structure, boundary-mismatch and overloaded-structural-region from group and concept strengths.

    Boundary pairs are those of a group's first concepts, as many as a report
    shows, with all others; ``boundary_totals`` counts all. ``samples(group,
    members)``: labels of some members, as evidence.
    """
    if samples is None:
        samples = summary.select("group", F.lit(None).cast("array<string>").alias("members"))
    named = strengths.select("group").distinct()
    unnamed = summary.join(named, "group", "left_anti").join(samples, "group", "left")
    strong = strengths.where("strength >= 2").select("group", "concept")
    # A pair stems from its later concept: only the first concepts of a group come before, so the pairs stay few.
    ranked = strong.withColumn("at", F.row_number().over(Window.partitionBy("group").orderBy("concept")))
    first = ranked.where(F.col("at") <= LIMITS["findings"])
    pairs = first.drop("at").join(strong.withColumnRenamed("concept", "other"), "group").where("concept < other").join(samples, "group", "left")
    many = strong.groupBy("group").agg(F.count("*").alias("concepts")).where("concepts >= 3")
    shown = first.groupBy("group").agg(F.array_sort(F.collect_list("concept")).alias("shown"))
    many = many.join(shown, "group").join(samples, "group", "left")
    return {
        "unnamed": unnamed.select(*finding("unnamed-structure", F.col("group"), _said("the group '{}' of {} members meets no canonical concept", "group", "size"), signal=F.when(F.col("size") >= 5, "strong").otherwise("moderate"), value=F.col("size"), size=F.col("size"), members=F.col("members"))),
        "boundary": pairs.select(*finding("boundary-mismatch", F.concat_ws(":", "group", "concept", "other"), _said("'{}' and '{}' are two concepts but both fit the group '{}'", "concept", "other", "group"), signal=F.lit("moderate"), concepts=F.array("concept", "other"), members=F.col("members"))),
        "overloaded": many.select(*finding("overloaded-structural-region", F.col("group"), _said("the group '{}' fits {} canonical concepts", "group", "concepts"), signal=F.lit("moderate"), value=F.col("concepts"), concepts=F.col("shown"), members=F.col("members"))),
    }


def boundary_totals(strengths: DataFrame) -> DataFrame:
    """(total): the number of pairs of concepts that strongly match one group, without making them."""
    n = F.count("*")
    return strengths.where("strength >= 2").groupBy("group").agg((n * (n - 1) / 2).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def divergence_findings(rows: DataFrame) -> DataFrame:
    """``matching.markdown_divergence`` rows as findings."""
    made = []
    for kind, template in (("canonical-absent", "the canonical '{}' isn't in the Markdown glossary"), ("superseded-present", "the Markdown glossary holds the superseded '{}' and not its canonical term")):
        made.append(rows.where(F.col("kind") == kind).select(*finding(kind, F.concat_ws(":", "concept", "term"), _said(template, "term"), certainty="observed")))
    return made[0].unionByName(made[1])


def drift(g: Glossary, synonyms: DataFrame, dispersion: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [parallel_terms(g, synonyms), watched_in_use(g), canonical_fading(g), canonical_overloaded(g, dispersion)])


def validation(g: Glossary, paths: DataFrame, strengths: DataFrame, summary: DataFrame, drifted: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    states = bindings(g, paths)
    return reduce(DataFrame.unionByName, [*structural(strengths, summary, samples).values(), orphaned_concepts(g, states), binding_findings(states, g), fragmentation(g), drifted])


def capped(findings: DataFrame, k: int = LIMITS["findings"]) -> DataFrame:
    """The first k findings of each kind, and each kind's exact total on every row."""
    totals = findings.groupBy("kind").agg(F.count("*").alias("total"))
    return per_key(findings, ["kind"], k, F.desc("value"), F.asc("subject")).drop("rank").join(totals, "kind")


def precision_recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, over (kind, subject)."""
    f, e = found.select("kind", "subject").distinct(), expected.select("kind", "subject").distinct()
    both = f.withColumn("f", F.lit(1)).join(e.withColumn("e", F.lit(1)), ["kind", "subject"], "full").na.fill(0, ["f", "e"])
    n = both.agg(F.coalesce(F.sum(F.col("f") * F.col("e")), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("f") * (1 - F.col("e"))), F.lit(0)).alias("fp"), F.coalesce(F.sum((1 - F.col("f")) * F.col("e")), F.lit(0)).alias("fn"))
    return n.select("tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def concept_tokens(g: Glossary) -> DataFrame:
    """(concept, token, own): the canonical terms' tokens, own, and those of their symbol bindings; scoped concepts stay out."""
    open_ = g.scopes.where("prefixes is null").select("concept")
    own = g.canonical.select("concept", F.explode("tokens").alias("token"), F.lit(True).alias("own"))
    symbols = g.rows.where("status = 'canonical'").select(F.col("id").alias("concept"), F.explode("bindings").alias("ref")).where(F.col("ref").startswith("symbol:"))
    symbols = symbols.select("concept", F.substring("ref", len("symbol:") + 1, LIMITS["label_chars"]).alias("name"))
    split = lexical.tokenize_distinct(symbols.select("name").distinct())
    own = own.union(symbols.join(split, "name").select("concept", F.explode("tokens").alias("token"), F.lit(False)))
    return own.join(open_, "concept", "left_semi").groupBy("concept", "token").agg(F.max("own").alias("own"))


def strengths(g: Glossary, nodes: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    tokens, _ = graph.member_tokens(members, nodes)
    names = lexical.tokenize_distinct(labels.select(F.col("label").alias("name")).distinct())
    named = labels.join(names, F.col("label") == F.col("name")).select("group", F.explode("tokens").alias("token"))
    return graph.concept_strength(tokens, named, concept_tokens(g))
