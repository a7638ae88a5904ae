"""python -m lexiloom.cli VERB ROOT: the engine over a repository."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .functions.fixed import LIMITS
from .plans import context, evidence, glossaries, report
from .session import session
from .sources import cache, documents, git, repository
from .sources.shared import sweep

OUT = "lexiloom-out"


def main(argv: list[str] | None = None) -> int:
    """0: fine; 1: findings or an invalid glossary; 2: the command can't run."""
    p = argparse.ArgumentParser(prog="lexiloom", description=__doc__)
    p.add_argument("verb", choices=["scan", "analyze", "inspect", "brief", "show", "save", "drift", "validate", "context-status", "sync-context", "clear-cache"])
    p.add_argument("root")
    p.add_argument("--limit", type=int, default=20, help="rows of a section that inspect prints")
    p.add_argument("--graph", help="a graph document (nodes, links, communities) for the structural checks")
    p.add_argument("--cache", help="folder of the extraction cache; on a cluster a shared one, else nothing is reused there")
    p.add_argument("--no-cache", action="store_true", help="split every file anew")
    p.add_argument("--file", default=context.HOSTS[0], choices=context.HOSTS, help="the instruction file with the managed block")
    p.add_argument("--repair", action="store_true", help="replace a managed block that was edited by hand")
    a = p.parse_args(argv)
    if not os.path.isdir(a.root):
        print(f"{a.root}: not a directory", file=sys.stderr)
        return 2
    if OUT in os.path.realpath(a.root).split(os.sep):
        print(f"{a.root}: lies in {OUT}, which this engine writes", file=sys.stderr)
        return 2
    at = os.path.join(a.root, OUT)
    entries = cache.location(a.root, a.cache)
    if a.verb == "clear-cache":
        print(cache.clear(entries) if entries else 0)
        return 0
    state, glossary = documents.read_json(os.path.join(at, "glossary.json"))
    if a.verb == "save":
        source = getattr(sys.stdin, "buffer", None)
        raw = source.read(LIMITS["json_bytes"] + 1) if source else sys.stdin.read(LIMITS["json_bytes"] + 1).encode()
        if len(raw) > LIMITS["json_bytes"]:
            print(f"over {LIMITS['json_bytes']} bytes", file=sys.stderr)
            return 1
        try:
            doc = json.loads(raw.decode("utf-8-sig"))
        except (ValueError, RecursionError):
            print("not JSON", file=sys.stderr)
            return 1
        if bad := glossaries.validate(doc):
            print("\n".join(bad), file=sys.stderr)
            return 1
        scoped = [c | {"scope": {"path_prefixes": sorted(c["scope"]["path_prefixes"])}} if "scope" in c else c for c in doc["concepts"]]
        documents.write_json(os.path.join(at, "glossary.json"), doc | {"concepts": sorted(scoped, key=lambda c: c["id"])})
        return 0
    if a.verb in ("brief", "show", "drift", "validate", "context-status", "sync-context"):
        if state != "ok" or (bad := glossaries.validate(glossary)):
            print(f"glossary: {state}" if state != "ok" else "\n".join(bad), file=sys.stderr)
            return 2
        if a.verb == "brief":
            print(evidence.brief(glossary), end="")
            return 0
        host = os.path.join(a.root, a.file)
        if a.verb == "context-status":
            state = context.status(context.read_host(host), glossary)
            print(state)
            return int(state != "current")
        if a.verb == "sync-context":
            state = context.sync(host, glossary, a.repair)
            print(f"{a.file}: was {state}")
            return int(state == "uninspectable" or (state == "edited" and not a.repair))
        if a.verb == "show":
            print("\n".join(report.glossary_lines(glossary)))
            return 0
    state, config = documents.read_json(os.path.join(a.root, "lexiloom.json"))
    if state not in ("ok", "absent"):
        print(f"lexiloom.json: {state}", file=sys.stderr)
        return 2
    spark = session()
    shared = a.cache or spark.sparkContext.master.startswith("local")
    reuse = cache.ExtractionCache(spark, entries) if entries and shared and not a.no_cache else None
    try:
        e = evidence.scan(spark, os.path.abspath(a.root), repository.Config.parse(config) if state == "ok" else None, reuse, a.graph)
        if a.verb in ("drift", "validate"):
            out = evidence.findings(spark, e, glossary, "drift" if a.verb == "drift" else "validation")
            out["glossary_git"] = git.path_state(os.path.abspath(a.root), f"{OUT}/glossary.json")
            documents.write_json(os.path.join(at, f"{a.verb}.json"), out)
            print("\n".join(report.finding_lines(out["findings"], out["sections"])))
            return int(bool(out["findings"]))
        doc = evidence.document(e, a.root)
        documents.write_json(os.path.join(at, "evidence.json"), doc)
        if a.verb == "inspect":
            try:
                print(json.dumps(report.project(doc, a.limit), sort_keys=True, ensure_ascii=False))
            except report.TooMuchOmitted as problem:
                print(problem, file=sys.stderr)
                return 2
        if a.verb == "analyze":
            print("\n".join(report.evidence_lines(doc)))
    finally:
        sweep(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
