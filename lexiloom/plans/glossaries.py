"""Glossaries: the closed schema, validation, and the standing glossary of the queries."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.fixed import LIMITS

SCHEMA = "id string, term string, definition string, status string, prefixes array<string>, aliases array<struct<term:string,status:string,note:string>>, bindings array<string>, notes string"
#: Statuses of concepts and aliases, kinds of bindings, and the fields of each part.
STATUSES = ("canonical", "proposed", "alias", "discouraged", "deprecated", "unknown")
BINDING_KINDS = ("symbol", "file", "module")
ALIAS_FIELDS, BINDING_FIELDS = {"term", "status", "note"}, {"ref"}
FIELDS = {"id", "term", "definition", "status", "scope", "aliases", "bindings", "notes"}
UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f‎‏‪-‮⁦-⁩\ud800-\udfff]")

#: The standing glossary: terms over the part, order and event vocabularies.
STANDING = {
    "schema_version": 1,
    "concepts": [
        {"id": "promo", "term": "Promo", "definition": "An offer.", "status": "canonical"},
        {"id": "part", "term": "Part Type", "definition": "A kind of part.", "status": "canonical", "aliases": [{"term": "standard", "status": "discouraged"}]},
        {"id": "urgent", "term": "Urgent", "definition": "First in line.", "status": "canonical", "scope": {"path_prefixes": ["orders"]}},
        {"id": "purchase", "term": "Purchase", "definition": "Goods for money.", "status": "canonical", "bindings": [{"ref": "symbol:purchase"}, {"ref": "module:events"}]},
        {"id": "workspace", "term": "Workspace", "definition": "A place.", "status": "canonical", "bindings": [{"ref": "symbol:Workspace"}, {"ref": "file:nowhere/at.sql"}, {"ref": "module:events/purchase.py"}]},
        {"id": "small", "term": "Small Plated", "definition": "Finish.", "status": "deprecated"},
        {"id": "steel", "term": "Steel", "definition": "A metal.", "status": "canonical"},
        {"id": "segment", "term": "Building", "definition": "A segment.", "status": "canonical", "scope": {"path_prefixes": ["customer"]}, "bindings": [{"ref": "file:customer/segments.sql"}, {"ref": "file:tools/size.py"}]},
        {"id": "widget", "term": "Widget", "definition": "A part.", "status": "canonical"},
        {"id": "bolt", "term": "Bolt", "definition": "A fastener.", "status": "canonical", "aliases": [{"term": "Gizmo", "status": "alias"}]},
        {"id": "ring", "term": "Cold Ring", "definition": "A part at rest.", "status": "canonical"},
        {"id": "drone", "term": "Drone", "definition": "Not made here.", "status": "canonical", "bindings": [{"ref": "file:vendor/drone.c"}]},
    ],
}


def fold_vocabulary(term: str) -> str:
    """The identity of a term: its words before any filter, so ``AlphaBeta`` and ``alpha_beta`` are one; without words its folded text."""
    words = lexical.split_term(term)
    return " ".join(words) if words else unicodedata.normalize("NFKC", term.strip()).casefold()


def _text(value: object, most: int, needed: bool = True) -> bool:
    return isinstance(value, str) and len(value) <= most and not UNSAFE.search(value) and (not needed or bool(value.strip()))


def _scope_problem(scope: object) -> str | None:
    prefixes = scope.get("path_prefixes") if isinstance(scope, dict) else None
    if not isinstance(scope, dict) or set(scope) - {"path_prefixes"} or not isinstance(prefixes, list) or not prefixes or any(not valid_prefix(p) for p in prefixes):
        return "needs literal path prefixes"
    # In order, a prefix is followed by what lies beneath it.
    ordered = sorted((p + "/" for p in prefixes))
    return "prefixes overlap" if any(b.startswith(a) for a, b in zip(ordered, ordered[1:])) else None


def _owners_meet(owners: list[tuple[str, tuple[str, ...] | None]]) -> tuple[str, str] | None:
    """Two concepts whose scopes meet, of the (concept, prefixes) that claim a word; one sort, not all pairs."""
    by_path: list[tuple[str, str]] = []
    whole: list[str] = []
    for concept, prefixes in owners:
        if prefixes is None:
            whole.append(concept)
        else:
            by_path += [(p + "/", concept) for p in prefixes]
    names = sorted({c for c, _ in owners})
    if whole and len(names) > 1:
        return whole[0], next(n for n in names if n != whole[0])
    open_: list[tuple[str, str]] = []
    for path, concept in sorted(by_path):
        while open_ and not path.startswith(open_[-1][0]):
            open_.pop()
        for _, other in open_:
            if other != concept:
                return other, concept
        open_.append((path, concept))
    return None


def validate(doc: dict) -> list[str]:
    """Messages about what is wrong, at most a hundred; a valid glossary has none."""
    bad: list[str] = []
    if not isinstance(doc, dict) or set(doc) - {"schema_version", "concepts"} or doc.get("schema_version") != 1 or not isinstance(doc.get("concepts"), list):
        return ["a glossary has schema_version 1 and a list of concepts, nothing else"]
    concepts = doc["concepts"]
    count = lambda k: sum(len(c[k]) for c in concepts if isinstance(c, dict) and isinstance(c.get(k), list))
    for what, n, most in (("concepts", len(concepts), LIMITS["glossary_concepts"]), ("aliases", count("aliases"), LIMITS["glossary_aliases"]), ("bindings", count("bindings"), LIMITS["glossary_bindings"])):
        if n > most:
            return [f"over {most} {what}"]
    seen: set[str] = set()
    owned: dict[str, list[tuple[str, tuple[str, ...] | None]]] = {}
    for i, c in enumerate(concepts):
        at = f"concepts[{i}]"
        if not isinstance(c, dict):
            bad.append(f"{at}: not an object")
            continue
        bad += [f"{at}: unknown field {k}" for k in sorted(set(c) - FIELDS)]
        for k, most in (("id", 1024), ("term", 1024), ("definition", 16_384)):
            if not _text(c.get(k), most):
                bad.append(f"{at}.{k}: needs safe text of 1 to {most} characters")
        if "notes" in c and not _text(c["notes"], 16_384, needed=False):
            bad.append(f"{at}.notes: needs safe text of at most 16384 characters")
        if c.get("status") not in STATUSES:
            bad.append(f"{at}.status: one of {', '.join(STATUSES)}")
        if isinstance(c.get("id"), str):
            if c["id"] in seen:
                bad.append(f"{at}.id: repeated")
            seen.add(c["id"])
        prefixes = None
        if "scope" in c:
            problem = _scope_problem(c["scope"])
            if problem:
                bad.append(f"{at}.scope: {problem}")
            else:
                prefixes = tuple(c["scope"]["path_prefixes"])
        names = [c.get("term")]
        aliases = c.get("aliases", [])
        if not isinstance(aliases, list):
            bad.append(f"{at}.aliases: a list")
            aliases = []
        for j, a in enumerate(aliases):
            if not isinstance(a, dict) or set(a) - ALIAS_FIELDS or a.get("status") not in STATUSES or not _text(a.get("term"), 1024) or ("note" in a and not _text(a["note"], 16_384, needed=False)):
                bad.append(f"{at}.aliases[{j}]: a term, a status of {', '.join(STATUSES)} and perhaps a note")
            else:
                names.append(a["term"])
        bindings = c.get("bindings", [])
        if not isinstance(bindings, list):
            bad.append(f"{at}.bindings: a list")
            bindings = []
        for j, b in enumerate(bindings):
            kind, colon, value = b["ref"].partition(":") if isinstance(b, dict) and isinstance(b.get("ref"), str) else ("", "", "")
            if not isinstance(b, dict) or set(b) - BINDING_FIELDS or not _text(b.get("ref"), 1024) or kind not in BINDING_KINDS or not value.strip():
                bad.append(f"{at}.bindings[{j}]: a ref of {', '.join(k + ':' for k in BINDING_KINDS)} and a name")
        for own in {fold_vocabulary(n) for n in names if isinstance(n, str)}:
            owned.setdefault(own, []).append((str(c.get("id")), prefixes))
    for word, own in owned.items():
        met = _owners_meet(own) if len(own) > 1 else None
        if met:
            bad.append(f"{word}: owned by {met[0]} and {met[1]} in overlapping scopes")
    return bad if len(bad) <= 100 else [*bad[:100], f"{len(bad) - 100} more"]


def valid_prefix(p: object) -> bool:
    """A literal relative POSIX prefix."""
    return isinstance(p, str) and 0 < len(p) <= LIMITS["path_chars"] and not re.search(r"[\\*?\[]", p) and not p.startswith("/") and all(x not in ("", ".", "..") for x in p.split("/"))


def to_frame(spark: SparkSession, doc: dict) -> DataFrame:
    if bad := validate(doc):
        raise ValueError("; ".join(bad))
    rows = [
        (c["id"], c["term"], c["definition"], c["status"], sorted(c["scope"]["path_prefixes"]) if c.get("scope") else None, [(a["term"], a["status"], a.get("note")) for a in c.get("aliases") or []], [b["ref"] for b in c.get("bindings") or []], c.get("notes"))
        for c in sorted(doc["concepts"], key=lambda c: c["id"])
    ]
    return spark.createDataFrame(rows, SCHEMA)


def all_terms(glossary: DataFrame) -> DataFrame:
    """(concept, term, status): every concept's term and its aliases."""
    own = glossary.select(F.col("id").alias("concept"), "term", "status")
    return own.union(glossary.select("id", F.explode("aliases").alias("a")).select("id", "a.term", "a.status"))


def canonical_json(doc: dict) -> str:
    return json.dumps(doc, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def digest(doc: dict) -> str:
    """SHA-256 of the canonical JSON, in hex: binds what is derived from a glossary to it."""
    return hashlib.sha256(canonical_json(doc).encode()).hexdigest()
