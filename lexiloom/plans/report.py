"""Bounded projections and text reports of the evidence and of findings."""

from __future__ import annotations

import json
import unicodedata

#: Characters of a text, records of what is left out, and characters of the whole projection.
TEXT, RECORDS, WHOLE = 512, 100, 1_000_000


class TooMuchOmitted(ValueError):
    """More kinds of omission than a projection may list."""


class Omissions:
    """One record per (path pattern, kind), with how often and how much; list positions are one pattern."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], list[int]] = {}

    def add(self, path: tuple[str, ...], kind: str, amount: int) -> None:
        record = self.held.setdefault(("/".join(path), kind), [0, 0])
        record[0], record[1] = record[0] + 1, record[1] + amount
        if len(self.held) > RECORDS:
            raise TooMuchOmitted(f"over {RECORDS} kinds of omission")

    def rows(self) -> list[dict]:
        return [{"path": p, "kind": k, "times": n, "amount": m} for (p, k), (n, m) in sorted(self.held.items())]


def _copy(value: object, path: tuple[str, ...], rows: int, left_out: Omissions) -> object:
    if isinstance(value, str) and len(value) > TEXT:
        left_out.add(path, "characters", len(value) - TEXT)
        return value[: TEXT - 1] + "…"
    if isinstance(value, list):
        if len(value) > rows:
            left_out.add(path, "rows", len(value) - rows)
        return [_copy(v, (*path, "*"), rows, left_out) for v in value[:rows]]
    if isinstance(value, dict):
        return {k: _copy(v, (*path, k), rows, left_out) for k, v in value.items()}
    return value


def project(doc: dict, rows: int = 20, whole: int = WHOLE) -> dict:
    """``doc`` with at most ``rows`` rows a list and TEXT characters a text, and records of what that leaves out.

    Over ``whole`` characters of JSON the largest sections go, one by one, each
    with a record; TooMuchOmitted beyond RECORDS records.
    """
    left_out = Omissions()
    out = _copy(doc, (), rows, left_out)
    size = lambda v: len(json.dumps(v, sort_keys=True, ensure_ascii=False))
    while size(out | {"omissions": left_out.rows()}) > whole and out:
        largest = max(sorted(out), key=lambda k: size(out[k]))
        left_out.add((largest,), "section", size(out.pop(largest)))
    return out | {"omissions": left_out.rows()}


def shown(text: object) -> str:
    """Text for a terminal: control, format and lone surrogate characters as escapes."""
    return "".join(c if unicodedata.category(c) not in ("Cc", "Cf", "Cs") else c.encode("unicode_escape").decode() for c in str(text))


def evidence_lines(doc: dict) -> list[str]:
    """The evidence document as lines of text."""
    out = ["Files"]
    total = doc["totals"]
    out.append(f"  code: {total['code_files']} files, {total['code_bytes']} bytes; prose: {total['doc_files']} files, {total['doc_words']} words")
    out += [f"  {kind}, {shown(role)}: {n} files" for kind in ("code", "doc") for role, n in sorted((total[f"{kind}_files_by_role"] or {}).items())]
    out += [f"  left out: {shown(r['sentence'])}" for r in doc["exclusions"]]
    if doc["layout"]["monorepo"]:
        out.append("  several projects: " + ", ".join(map(shown, doc["layout"]["workspaces"])))
    for name in ("tokens", "identifiers", "doc_terms"):
        led = doc[name]["coverage"]
        out.append(f"{name.replace('_', ' ').capitalize()}: {led['included_items']} of {led['total_items']}" + ("" if led["complete"] else f" ({'; '.join(led['reasons'])})"))
    out.append("Register")
    out += [f"  {shown(r['style'])}: {r['spellings']} spellings" for r in doc["register"]["styles"]]
    for title, key, line in (
        ("Synonym candidates", "synonyms", lambda r: f"{r['a']} / {r['b']}: similarity {r['similarity']}"),
        ("Overloaded terms", "overloads", lambda r: f"{r['term']}: dispersion {r['dispersion']} over {r['modules']} modules"),
    ):
        out.append(f"{title}: {len(doc[key])}")
        out += ["  " + shown(line(r)) for r in doc[key]]
    out.append("Names to settle")
    out += [f"  {shown(r.get('term') or r.get('module'))}: {r['score']}" for kind in ("terms", "modules") for r in doc["naming"][kind]]
    s = doc["structure"]
    out.append(f"Graph: {s['state']}" + (f", {s['freshness']}, {s['groups']['coverage']['total_items']} groups" if s["state"] == "ok" else ""))
    return out


def finding_lines(found: list[dict], sections: list[dict]) -> list[str]:
    """Findings by section as lines of text, with totals, what is left out and why."""
    out = []
    for s in sections:
        title = f"{s['kind']}: " + (f"skipped ({s['skipped']})" if s["skipped"] else f"{s['total']}" + ("" if s["exact"] else " or more") + (f", {s['dropped']} not shown" if s["dropped"] else ""))
        out.append(title)
        for f in found:
            if f["kind"] == s["kind"] and not s["skipped"]:
                out.append(f"  {shown(f.get('summary') or f['subject'])}\t{f['signal_strength'] or f['certainty']}")
                out += detail_lines(f)
        if not s["skipped"]:
            out += [f"  incomplete: {shown(r)}" for r in s["reasons"]]
    return out


def detail_lines(found: dict) -> list[str]:
    """What a finding rests on: scope, contexts, first places, modules."""
    held = found.get("evidence") or {}
    lists = (("scope", found.get("scope")), ("shared contexts", held.get("shared_contexts")), ("at", [x["path"] for x in held.get("locations") or []][:3]), ("modules", [x["module"] for x in held.get("module_contexts") or []]), ("members", held.get("members")))
    return [f"    {name}: " + ", ".join(map(shown, own)) for name, own in lists if own]


def glossary_lines(doc: dict) -> list[str]:
    """Counts by status, then the concepts."""
    counts: dict[str, int] = {}
    for c in doc["concepts"]:
        counts[c["status"]] = counts.get(c["status"], 0) + 1
    head = f"{len(doc['concepts'])} concepts" + "".join(f", {n} {s}" for s, n in sorted(counts.items()))
    return [head, *[f"{shown(c['id'])}\t{c['status']}\t{shown(c['term'])}\t{shown(c['definition'])}" for c in doc["concepts"]]]
