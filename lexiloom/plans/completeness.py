"""What a list of findings can't vouch for: totals, whether they are exact, and the reasons why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LIMITS
from ..operators.topk import carried, ledger

DRIFT = ("parallel-term", "watched-term-in-use", "canonical-fading", "canonical-overloaded")
STRUCTURAL = ("unnamed-structure", "boundary-mismatch", "overloaded-structural-region")
VALIDATION = (*STRUCTURAL, "orphaned-concept", "binding-unresolved", "binding-out-of-scope", "fragmentation", *DRIFT)

#: Kinds of exclusion that leave production files unread, and those whose paths a binding may name.
UNREAD_KINDS = ("corpus-budget", "walk-budget", "directory-too-large", "too-large", "unreadable")
EXCLUDED_KINDS = ("ignored", "generated", "vendored", "sensitive", "too-large", "symlink-escapes", "symlink-directory", "unreadable", "hidden", "own-output", "unsupported")

#: Kinds that claim that something is absent; a corpus that isn't whole can't prove it.
ABSENCE = ("canonical-fading", "orphaned-concept")

SCOPED = "path-scoped concepts are left out: groups of a graph carry no paths"


def corpus_reasons(exclusions: dict[str, int]) -> list[str]:
    """Why the production corpus isn't whole, from files by kind of exclusion; none: it is."""
    return [f"{exclusions[kind]} file(s) or folder(s) left out: {kind}" for kind in UNREAD_KINDS if exclusions.get(kind)]


def withhold(planned: dict[str, dict], totals: dict[str, int], corpus: list[str]) -> dict[str, int]:
    """{kind: findings} of absence that a corpus with omissions withholds; ``planned`` gets the reasons, ``totals`` loses them."""
    held = {k: totals.pop(k) for k in ABSENCE if corpus and totals.get(k)}
    for kind, n in held.items():
        planned[kind]["reasons"].append(f"{n} finding(s) of absence withheld: the corpus isn't whole")
    return held


def overload_reasons(scoped: DataFrame) -> list[str]:
    """``checks.scoped_dispersion`` rows that its evidence can't decide."""
    n = scoped.where("not whole").count()
    return [f"{n} scoped overload check(s) omitted: modules or contexts are shown in part"] if n else []


def graph_reasons(groups: int) -> list[str]:
    return [f"{groups - LIMITS['groups']} group(s) beyond the cap of {LIMITS['groups']}"] if groups > LIMITS["groups"] else []


def plan(kinds: tuple[str, ...], corpus: list[str], overload: list[str], graph_state: str, groups: list[str], scoped: int) -> dict[str, dict]:
    """Per kind {skipped, reasons}: what is known before any finding is counted."""
    out = {}
    for kind in kinds:
        reasons, skipped = list(carried({"reasons": corpus}, "corpus")), None
        if kind == "canonical-overloaded":
            reasons += overload
        if kind in STRUCTURAL:
            reasons += groups
            if graph_state != "ok":
                skipped, reasons = f"graph {graph_state}; structural checks need one", []
            elif scoped:
                reasons.append(SCOPED)
                skipped = SCOPED if kind == "unnamed-structure" else None
        out[kind] = {"skipped": skipped, "reasons": reasons}
    return out


def sections(findings: DataFrame, planned: dict[str, dict], cap: int = LIMITS["findings"], totals: dict[str, int] | None = None) -> DataFrame:
    """(kind, total, included, dropped, exact, complete, skipped, reasons): a row a kind, found or not; ``totals`` overrides counts."""
    spark = findings.sparkSession
    held = spark.createDataFrame([(k, v["skipped"], v["reasons"], (totals or {}).get(k)) for k, v in planned.items()], "kind string, skipped string, why array<string>, known long")
    counts = findings.groupBy("kind").agg(F.count("*").alias("n"))
    rows = held.join(counts, "kind", "left").withColumn("total", F.when(F.col("skipped").isNotNull(), F.lit(0)).otherwise(F.coalesce("known", "n", F.lit(0))))
    included = F.least("total", F.lit(cap))
    capped = F.when(F.col("total") > cap, F.array(F.concat(F.lit("the cap is "), F.lit(str(cap)), F.lit(" findings")))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("kind", F.col("total").cast("long").alias("total"), included.cast("long").alias("included"), (F.col("total") - included).cast("long").alias("dropped"), (F.size("why") == 0).alias("exact"), "skipped", F.array_distinct(F.concat("why", capped)).alias("reasons"))
    return rows.withColumn("complete", F.col("skipped").isNull() & F.col("exact") & (F.col("dropped") == 0))


def limitations(rows: list[dict]) -> list[str]:
    """The reasons of all sections that aren't skipped and whose totals aren't exact, each once, in order."""
    return list(dict.fromkeys(r for row in rows if not row["exact"] and not row["skipped"] for r in row["reasons"]))


def status_counts(glossary: DataFrame) -> DataFrame:
    """(status, concepts, aliases)."""
    own = glossary.groupBy("status").agg(F.count("*").alias("concepts"))
    named = glossary.select(F.explode("aliases").alias("a")).groupBy(F.col("a.status").alias("status")).agg(F.count("*").alias("aliases"))
    return own.join(named, "status", "full").na.fill(0, ["concepts", "aliases"])


def rollup(locations: DataFrame) -> DataFrame:
    """(key, module, uses, files) of (key, module, path, n): where a term's uses lie, module by module."""
    per = locations.groupBy("key", "module", "path").agg(F.sum("n").alias("n"))
    return per.groupBy("key", "module").agg(F.sum("n").alias("uses"), F.count("*").alias("files"))


__all__ = ["DRIFT", "EXCLUDED_KINDS", "VALIDATION", "corpus_reasons", "graph_reasons", "ledger", "limitations", "overload_reasons", "plan", "rollup", "sections", "status_counts"]
