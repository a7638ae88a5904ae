"""Naming scores of modules and terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.paths import name_of
from . import imports, vocabulary
from .topk import top_k

CANONICAL, DISAMBIGUATE = "deserves a canonical name", "deserves disambiguation"


def module_scores(edges: DataFrame, modules: DataFrame, doc_counts: DataFrame, cap: int | None = 10) -> DataFrame:
    """(module, score, importers, imported, code_files, doc_mentions) of imported modules but the root.

    3 importers + 2 ln(1 + files) + ln(1 + uses) + 2 ln(1 + mentions of the last path part).
    """
    d = imports.degrees(edges).where("fan_in > 0 and module != '.'").withColumn("base", F.lower(name_of(F.col("module"))))
    joined = d.join(modules.select("module", "code_files"), "module", "left").join(doc_counts.select(F.col("term").alias("base"), F.col("uses").alias("mentions")), "base", "left")
    files, said = F.coalesce("code_files", F.lit(0)), F.coalesce("mentions", F.lit(0))
    score = 3 * F.col("fan_in") + 2 * F.log1p(files.cast("double")) + F.log1p(F.col("weight").cast("double")) + 2 * F.log1p(said.cast("double"))
    out = joined.select("module", F.round(score, 2).alias("score"), F.col("fan_in").alias("importers"), F.col("fan_out").alias("imported"), files.alias("code_files"), said.alias("doc_mentions"))
    return out if cap is None else top_k(out, cap, F.desc("score"), F.asc("module"))


def _named(tok_occ: DataFrame) -> DataFrame:
    stems = vocabulary.by_token(tok_occ).select("token", "path").distinct().withColumn("stem", lexical.tokens(F.regexp_replace(name_of(F.col("path")), r"(?<=.)\.[^.]*$", "")))
    return stems.where((F.size("stem") == 1) & (F.element_at("stem", 1) == F.col("token"))).select("token").distinct()


def term_scores(tok_occ: DataFrame | None, token_counts: DataFrame, doc_counts: DataFrame, dispersion: DataFrame, cap: int | None = 15, named: DataFrame | None = None, pats: DataFrame | None = None) -> DataFrame:
    """(term, score, nomination, uses, files, modules, doc_mentions, compounds, compound_uses, names_file) of domain tokens in two modules or more.

    ``named(token)``: tokens that name a file they are in, if known; else ``tok_occ`` has names and paths to tell them by.
    ``pats(token, compounds, compound_uses)``: the number and uses of a token's patterns, if known; else they are made of ``tok_occ``.
    """
    if pats is None:
        pats = vocabulary.token_patterns(tok_occ).groupBy("token").agg(F.count("*").alias("compounds"), F.sum("uses").alias("compound_uses"))
    if named is None:
        named = _named(tok_occ)
    named = named.withColumn("named", F.lit(1))
    t = (
        token_counts.where("origin = 'domain' and modules >= 2").join(pats, "token", "left").join(named, "token", "left")
        .join(doc_counts.select(F.col("term").alias("token"), F.col("uses").alias("said")), "token", "left")
        .join(dispersion.select(F.col("term").alias("token"), "divergent"), "token", "left").na.fill(0, ["compounds", "compound_uses", "named", "said"])
    )
    n = F.greatest(F.lit(1), F.col("uses"))
    score = (
        2 * F.col("modules") + F.log1p(F.least("uses", F.lit(100)).cast("double")) + 2 * F.log1p(F.col("said").cast("double")) + 8 * F.col("compounds") / F.sqrt(n)
        + 6 * F.col("compounds") / F.greatest(F.lit(1), F.col("files")) + 4 * F.col("compound_uses") / n + 15 * F.col("named")
    )
    kind = F.when(F.coalesce("divergent", F.lit(False)), DISAMBIGUATE).otherwise(CANONICAL)
    out = t.select(F.col("token").alias("term"), F.round(score, 2).alias("score"), kind.alias("nomination"), "uses", "files", "modules", F.col("said").alias("doc_mentions"), "compounds", "compound_uses", (F.col("named") == 1).alias("names_file"))
    return out if cap is None else top_k(out, cap, F.desc("score"), F.asc("term"))
