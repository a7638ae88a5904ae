"""Occurrences of glossary terms in the evidence."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.fixed import LIMITS
from ..functions.paths import in_scope
from .vocabulary import by_token


def term_tokens(terms: DataFrame) -> DataFrame:
    """``terms(concept, term, status)`` with tokens; terms of over 32 tokens match nothing.

    A glossary has at most ten thousand concepts, so its terms are split here.
    """
    rows = [(*r, split) for r in terms.collect() if len(split := lexical.split_tokens(r["term"])) <= LIMITS["compound_tokens"]]
    return terms.sparkSession.createDataFrame(rows, "concept string, term string, status string, tokens array<string>")


def single_occurrences(terms: DataFrame, tok_occ: DataFrame) -> DataFrame:
    """Uses (concept, term, name, path, module, n) of terms with one token."""
    one = terms.where(F.size("tokens") == 1).select("concept", "term", F.element_at("tokens", 1).alias("token"))
    return by_token(tok_occ).join(one, "token").select("concept", "term", "name", "path", "module", "n")


def compound_occurrences(terms: DataFrame, tok_occ: DataFrame) -> DataFrame:
    """Uses of terms with several tokens: identifiers that hold them side by side, each identifier once a term.

    Only n-grams of lengths that some term has are made, from distinct token
    lists, and meet the terms in one equality join.
    """
    many = terms.where(F.size("tokens") > 1).select("concept", "term", "tokens", F.size("tokens").alias("k"))
    lengths = many.select("k").distinct()
    lists = tok_occ.select("tokens").distinct().withColumnRenamed("tokens", "held")
    grams = lists.join(lengths, F.size("held") >= F.col("k")).select("held", F.explode(F.transform(F.sequence(F.lit(1), F.size("held") - F.col("k") + 1), lambda i: F.slice("held", i, F.col("k")))).alias("gram")).distinct()
    hit = grams.join(many, F.col("gram") == F.col("tokens")).select("concept", "term", "held").distinct()
    return tok_occ.join(hit, F.col("tokens") == F.col("held")).select("concept", "term", "name", "path", "module", "n")


def occurrences(terms: DataFrame, tok_occ: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """All uses; ``scopes(concept, prefixes)`` keeps those inside a concept's scope."""
    uses = single_occurrences(terms, tok_occ).union(compound_occurrences(terms, tok_occ))
    if scopes is not None:
        uses = uses.join(scopes, "concept", "left").where(in_scope(F.col("path"), F.col("prefixes"))).drop("prefixes")
    return uses


def occurrence_totals(terms: DataFrame, uses: DataFrame) -> DataFrame:
    """(concept, term, uses, files, modules) for every term, zeros included."""
    got = uses.groupBy("concept", "term").agg(F.sum("n").alias("uses"), F.countDistinct("path").alias("files"), F.countDistinct("module").alias("modules"))
    return terms.select("concept", "term").distinct().join(got, ["concept", "term"], "left").na.fill(0)


def doc_occurrence(terms: DataFrame, doc_counts: DataFrame) -> DataFrame:
    """(concept, term, doc_uses): prose uses of terms that are one prose word; null where that can't be proven."""
    words = F.regexp_extract_all(F.col("term"), F.lit(lexical.PROSE), F.lit(0))
    keyed = terms.select("concept", "term", F.when(F.size(words) == 1, F.element_at(lexical.doc_words(F.col("term")), 1)).alias("word"))
    got = keyed.join(doc_counts.select(F.col("term").alias("word"), "uses"), "word", "left")
    return got.select("concept", "term", F.when(F.col("word").isNotNull(), F.coalesce("uses", F.lit(0))).alias("doc_uses"))


#: Limits of the comparison with a Markdown glossary: terms looked up, and characters of the folded page.
MOST_TERMS, MOST_CHARACTERS = 500, 4_000_000
SUPERSEDED = ("alias", "discouraged", "deprecated")


def fold_page(text: str) -> str:
    """NFKC and full case folding, with every run of white space as one space."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def spellings(term: str) -> set[str]:
    """The folded spellings under which a term counts as present: as it is, joined, and with underscores or hyphens for its spaces."""
    folded = fold_page(term)
    return {folded.replace(" ", by) for by in (" ", "", "_", "-")} if folded else set()


def term_automaton(terms: list[str]) -> ahocorasick.Automaton:
    """One automaton over all spellings; it yields lists of places in ``terms``."""
    by: dict[str, list[int]] = {}
    for i, term in enumerate(terms):
        for spelled in spellings(term):
            by.setdefault(spelled, []).append(i)
    found = ahocorasick.Automaton()
    for spelled, own in by.items():
        found.add_word(spelled, own)
    found.make_automaton()
    return found


def present(found: ahocorasick.Automaton, folded: str) -> set[int]:
    """The places of the terms that a folded text holds anywhere, inside words too."""
    seen: set[int] = set()
    if len(found):
        for _, own in found.iter(folded):
            seen.update(own)
    return seen


def term_presence(texts: DataFrame, terms: list[str], id_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, term): each of at most ``MOST_TERMS`` distinct terms that a text holds in some spelling; whole texts, in one pass each.

    The automaton goes to the tasks with the function: its size is bounded by
    the terms. Nulls and empty texts hold nothing; a term without characters
    is in no text. Rows that repeat an id are told apart by nothing, so each
    gives its own rows.
    """
    terms = list(dict.fromkeys(terms))
    if len(terms) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms")
    found, kind = term_automaton(terms), texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                rows = [(i, t) for i, text in enumerate(part.column(1).to_pylist()) if text for t in sorted(present(found, fold_page(text)))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([terms[t] for _, t in rows], pa.string())], names=["id", "term"])

    return texts.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, term string")


def markdown_divergence(glossary: DataFrame, text: str, whole: bool = False) -> tuple[DataFrame, dict]:
    """(concept, term, status, kind) of a glossary against a Markdown page, and {checked, skipped, complete, reason}.

    Canonical terms that the page lacks, and superseded aliases of those that it
    still holds. The page is one text and a glossary has bounded terms, so both
    are compared on the driver. Beyond the limits nothing is claimed; ``whole``
    has none and compares every term with a page of any length.
    """
    concepts = glossary.where("status = 'canonical'").select("id", "term", "aliases").orderBy("id").collect()
    asked = [row for c in concepts for row in [(c["id"], c["term"], "canonical"), *((c["id"], a["term"], a["status"]) for a in c["aliases"] or [] if a["status"] in SUPERSEDED)]]
    normal, reason = unicodedata.normalize("NFKC", text), None
    folded = normal.casefold() if whole or len(normal) <= MOST_CHARACTERS else normal  # a folded text may be longer
    if whole:
        checked = asked
    elif len(folded) > MOST_CHARACTERS:
        checked, reason = [], f"the page has over {MOST_CHARACTERS} characters"
    else:
        checked = asked[:MOST_TERMS]
        reason = f"{len(asked) - MOST_TERMS} term(s) beyond {MOST_TERMS}" if len(asked) > MOST_TERMS else None
    terms = list(dict.fromkeys(t for _, t, _ in checked))
    held = {terms[i] for i in present(term_automaton(terms), " ".join(folded.split()))} if checked else set()
    absent = {c for c, t, status in checked if status == "canonical" and t not in held}
    rows = [(c, t, s, "canonical-absent") for c, t, s in checked if s == "canonical" and c in absent] + [(c, t, s, "superseded-present") for c, t, s in checked if s != "canonical" and c in absent and t in held]
    info = {"checked": len(checked), "skipped": len(asked) - len(checked), "complete": len(checked) == len(asked), "reason": reason}
    return glossary.sparkSession.createDataFrame(rows, "concept string, term string, status string, kind string"), info
