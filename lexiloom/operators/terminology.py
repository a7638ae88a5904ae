"""Register, layers, synonym candidates, context dispersion and overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.fixed import LIMITS
from . import vocabulary
from ..sources.shared import cut
from .topk import per_key, top_k

# Gates of the mining operators.
CO_RATE, FILE_OVERLAP, SHARED, SIMILARITY, SYNONYMS = 0.2, 0.2, 2, 0.55, 20
LEAST_MODULES, DIVERGENT, OVERLOADS = 3, 0.8, 10


def register(tok_occ: DataFrame, doc_counts: DataFrame) -> DataFrame:
    """Per spelling: style, number of tokens, first and last token, and why it counts or not (reason).

    Structured spellings of two or more tokens count. Flat ones don't if a token
    belongs to its language, or if prose uses one of its tokens more often than
    code uses the spelling.
    """
    names = tok_occ.groupBy("name", "tokens").agg(F.sum("n").alias("uses"))
    origins = vocabulary.token_counts(tok_occ).select("token", "origin")
    facts = (
        names.select("name", F.explode("tokens").alias("token"))
        .join(origins, "token", "left").join(doc_counts.select(F.col("term").alias("token"), F.col("uses").alias("doc_uses")), "token", "left")
        .groupBy("name").agg(F.max(F.coalesce(F.col("origin") == "language", F.lit(False))).alias("of_language"), F.max(F.coalesce("doc_uses", F.lit(0))).alias("doc_uses"))
    )
    style = lexical.identifier_style(F.col("name"))
    structured = style.isin(*lexical.STRUCTURED) & (F.size("tokens") >= 2)
    reason = (
        F.when(F.size("tokens") == 0, "no_lexical_tokens").when(structured, "structurally_styled")
        .when(F.col("of_language"), "language_tagged_flat").when(F.col("doc_uses") > F.col("uses"), "prose_dominated_flat").otherwise("corroborated_flat")
    )
    out = names.join(facts, "name", "left").select("name", "uses", style.alias("style"), F.size("tokens").cast("long").alias("token_count"), F.try_element_at("tokens", F.lit(1)).alias("prefix"), F.try_element_at("tokens", F.lit(-1)).alias("suffix"), reason.alias("reason"))
    return out.withColumn("used", F.col("reason").isin("structurally_styled", "corroborated_flat"))


def style_shares(registered: DataFrame) -> DataFrame:
    """(style, spellings, pct) of the structured spellings."""
    styles = registered.where("reason = 'structurally_styled'").groupBy("style").agg(F.count("*").alias("spellings"))
    total = styles.agg(F.sum("spellings").alias("total"))
    return styles.join(total).select("style", "spellings", F.round(100.0 * F.col("spellings") / F.col("total"), 1).alias("pct"))


def token_count_shares(registered: DataFrame) -> DataFrame:
    bucket = F.when(F.col("token_count") <= 3, F.col("token_count").cast("string")).otherwise("4+")
    sizes = registered.where("reason = 'structurally_styled'").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("spellings"))
    return sizes.join(sizes.agg(F.sum("spellings").alias("total"))).select("bucket", "spellings", F.round(100.0 * F.col("spellings") / F.col("total"), 1).alias("pct"))


def affixes(registered: DataFrame, side: str, cap: int = 8) -> DataFrame:
    """The most frequent first or last tokens of used spellings; at least two."""
    counts = registered.where("used and token_count >= 2").groupBy(F.col(side).alias("token")).agg(F.count("*").alias("spellings")).where("spellings >= 2")
    return top_k(counts, cap, F.desc("spellings"), F.asc("token"))


def exemplars(registered: DataFrame, cap: int = 24) -> DataFrame:
    return top_k(registered.where("reason = 'structurally_styled'").select("name", "style", "uses"), cap, F.desc("uses"), F.asc("name"))


def layers(token_counts: DataFrame, doc_counts: DataFrame, which: str, cap: int = 10) -> DataFrame:
    """shared, code_only or doc_only: the top terms of the two vocabularies' intersection and differences."""
    code = token_counts.where("origin = 'domain'").select(F.col("token").alias("term"), F.col("uses").alias("code_uses"))
    docs = doc_counts.select("term", F.col("uses").alias("doc_uses"))
    if which == "shared":
        return top_k(code.join(docs, "term"), cap, F.desc(F.least("code_uses", "doc_uses")), F.asc("term"))
    left, right = (code, docs) if which == "code_only" else (docs, code)
    return top_k(left.join(right, "term", "left_anti"), cap, F.desc(left.columns[1]), F.asc("term"))


def eligible(token_counts: DataFrame, cap: int = LIMITS["pair_top"]) -> DataFrame:
    """(token, uses, rank): the most used domain tokens with two uses or more; at most ``cap`` rows."""
    top = top_k(token_counts.where("origin = 'domain' and uses >= 2").select("token", "uses"), cap, F.desc("uses"), F.asc("token"))
    return top.withColumn("one", F.lit(1)).transform(lambda d: per_key(d, ["one"], cap, F.desc("uses"), F.asc("token"))).drop("one")


def synonym_candidates(tok_occ: DataFrame, token_counts: DataFrame, top: int = LIMITS["pair_top"], cap: int | None = SYNONYMS) -> DataFrame:
    """(a, b, similarity, file_overlap_rate, shared_contexts, shared_patterns, contexts, patterns), a the higher-ranked token.

    Candidates come from shared substitution patterns by an equality join, since
    two shared patterns are required; the cheap gates follow, and the weighted
    cosine over contexts is taken last. All sides are bounded by ``top`` tokens.
    """
    best = eligible(token_counts, top)
    names = best.select("token")
    # Each of these is read several times below, so it is written once.
    pats = cut(vocabulary.token_patterns(tok_occ).join(names, "token", "left_semi"))
    p1, p2 = (pats.join(best.select("token", "rank"), "token").select(F.col("token").alias(t), F.col("rank").alias(f"r{t}"), "pattern", F.col("uses").alias(f"u{t}")) for t in "ab")
    pairs = p1.join(p2, "pattern").where("ra < rb").groupBy("a", "b").agg(F.count("*").alias("shared_patterns"), F.array_sort(F.collect_list(F.struct((-F.least("ua", "ub")).alias("u"), "pattern"))).alias("p")).where(F.col("shared_patterns") >= SHARED)
    paths = cut(vocabulary.by_token(tok_occ).join(names, "token", "left_semi").select("token", "path").distinct())
    files = paths.groupBy("token").agg(F.count("*").alias("files"))
    both = pairs.select("a", "b").join(paths.select(F.col("token").alias("a"), "path"), "a").join(paths.select(F.col("token").alias("b"), "path"), ["b", "path"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    pairs = (
        pairs.join(both, ["a", "b"], "left")
        .join(files.select(F.col("token").alias("a"), F.col("files").alias("fa")), "a").join(files.select(F.col("token").alias("b"), F.col("files").alias("fb")), "b")
        .withColumn("overlap", F.coalesce("common", F.lit(0)) / F.greatest(F.lit(1), F.least("fa", "fb"))).where(F.col("overlap") <= FILE_OVERLAP)
    )
    near = cut(vocabulary.neighbor_pairs(tok_occ, [], names))
    uses = token_counts.select("token", "uses")
    direct = pairs.join(near, ["a", "b"], "left").join(uses.select(F.col("token").alias("a"), F.col("uses").alias("na")), "a").join(uses.select(F.col("token").alias("b"), F.col("uses").alias("nb")), "b")
    pairs = direct.where(F.coalesce("uses", F.lit(0)) / F.greatest(F.lit(1), F.least("na", "nb")) <= CO_RATE).select("a", "b", "overlap", "shared_patterns", "p")
    pairs = cut(pairs)
    weight = 1 / (1 + F.log1p(F.col("uses").cast("double")))
    ctx = near.select(F.col("a").alias("t"), F.col("b").alias("k"), F.col("uses").alias("c")).join(uses.select(F.col("token").alias("k"), weight.alias("w")), "k", "left").withColumn("w", F.coalesce("w", F.lit(1 / (1 + 0.6931471805599453))))
    ca, cb = (ctx.select(F.col("t").alias(t), "k", F.col("c").alias(f"c{t}"), "w") for t in "ab")
    norm = lambda t, c: pairs.select("a", "b").join(c, t).where("k != a and k != b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col(f"c{t}") * F.col("w")) ** 2)).alias(f"norm_{t}"))
    dot = (
        pairs.select("a", "b").join(ca, "a").join(cb.drop("w"), ["b", "k"]).where("k != a and k != b")
        .groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb") * F.col("w") ** 2).alias("dot"), F.count("*").alias("shared_contexts"), F.array_sort(F.collect_list(F.struct((-F.least("ca", "cb")).alias("u"), "k"))).alias("c"))
        .where(F.col("shared_contexts") >= SHARED)
    )
    sim = F.col("dot") / (F.col("norm_a") * F.col("norm_b"))
    scored = pairs.join(dot, ["a", "b"]).join(norm("a", ca), ["a", "b"]).join(norm("b", cb), ["a", "b"]).where(sim >= SIMILARITY)
    out = scored.select("a", "b", F.round(sim, 3).alias("similarity"), F.round("overlap", 3).alias("file_overlap_rate"), "shared_contexts", "shared_patterns", F.array_join(F.slice("c.k", 1, 5), " ").alias("contexts"), F.array_join(F.slice("p.pattern", 1, 5), " ").alias("patterns"))
    return out if cap is None else top_k(out, cap, F.desc("similarity"), F.asc("a"), F.asc("b"))


def context_dispersion(tok_occ: DataFrame, token_counts: DataFrame, top: int | None = LIMITS["pair_top"], cap: int | None = LIMITS["module_contexts"], most: int | None = LIMITS["overload_modules"]) -> DataFrame:
    """(term, dispersion, modules, divergent): one minus the mean Jaccard similarity of a term's contexts in its modules.

    Terms with a truncated context set, under three modules or over ``most`` are left out. Sets are bounded by ``cap``.
    Without ``top``, ``cap`` and ``most`` every term of three modules has a dispersion, over all of its contexts.
    """
    only = None if top is None else eligible(token_counts, top).select("token")
    pairs = vocabulary.neighbor_pairs(tok_occ, ["module"], only)
    sized = pairs.groupBy("a", "module").agg(F.count("*").alias("n"))
    fit = sized.groupBy("a").agg(F.count("*").alias("modules"), F.max("n").alias("most")).where(F.col("modules") >= LEAST_MODULES)
    if most is not None:
        fit = fit.where(F.col("modules") <= most)
    if cap is not None:
        fit = fit.where(F.col("most") <= cap)
    sets = pairs.join(fit, "a").groupBy("a", "modules", "module").agg(F.collect_set("b").alias("s"))
    x, y = sets, sets.select("a", F.col("module").alias("m2"), F.col("s").alias("s2"))
    jac = F.size(F.array_intersect("s", "s2")) / F.size(F.array_union("s", "s2"))
    out = x.join(y, "a").where("module < m2").groupBy(F.col("a").alias("term"), "modules").agg(F.round(1 - F.avg(jac), 3).alias("dispersion"))
    return out.select("term", "dispersion", "modules", (F.col("dispersion") >= DIVERGENT).alias("divergent"))


def overload_candidates(dispersion: DataFrame, cap: int = OVERLOADS) -> DataFrame:
    return top_k(dispersion.where("divergent"), cap, F.desc("dispersion"), F.asc("term"))


def overload_modules(tok_occ: DataFrame, overloads: DataFrame, modules: int = 4, contexts: int = 5) -> DataFrame:
    """(term, module, uses, contexts): each overloaded term's largest modules with the first contexts."""
    per = vocabulary.by_token(tok_occ).join(overloads.select(F.col("term").alias("token")), "token", "left_semi").groupBy(F.col("token").alias("term"), "module").agg(F.sum("n").alias("uses"))
    best = per_key(per, ["term"], modules, F.desc("uses"), F.asc("module")).drop("rank")
    near = vocabulary.neighbor_pairs(tok_occ, ["module"], overloads.select(F.col("term").alias("token"))).select(F.col("a").alias("term"), "module", "b")
    first = per_key(near, ["term", "module"], contexts, F.asc("b")).groupBy("term", "module").agg(F.array_join(F.array_sort(F.collect_list("b")), " ").alias("contexts"))
    return best.join(first, ["term", "module"], "left")
