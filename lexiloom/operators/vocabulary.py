"""Vocabulary aggregates over identifier and prose occurrences.

``ident_occ(name, path, module, language, n)`` and ``doc_occ(term, path, n)``
are the two fact tables. Each view is one grouped aggregate; partial sums
combine before every shuffle, so a ubiquitous token costs one row a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import lexical
from ..functions.fixed import LIMITS
from ..sources.shared import cut

IDENT_OCC = "name string, path string, module string, language string, n long"
DOC_OCC = "term string, path string, n long"


def code_occurrences(files: DataFrame) -> DataFrame:
    """ident_occ of ``files(path, module, language, text)``, in NFKC."""
    files = lexical.normalize_text(files.select("path", "module", "language", "text"), "text")
    found = files.select("path", "module", "language", F.explode(lexical.identifiers(F.col("text"), F.col("language"))).alias("name"))
    return found.groupBy("name", "path", "module", "language").agg(F.count("*").alias("n")).select("name", "path", "module", "language", "n")


def doc_occurrences(files: DataFrame) -> DataFrame:
    """doc_occ of ``files(path, text)``, in NFKC and folded."""
    files = lexical.normalize_text(files.select("path", "text"), "text", form="FOLD")
    return files.select("path", F.explode(lexical.doc_words(F.col("text"))).alias("term")).groupBy("term", "path").agg(F.count("*").alias("n"))


#: Words whose numbers a task counts at once, unless one file has more.
WORDS_AT_ONCE = 1 << 21


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch whose last column are words, cut between files by the number of words."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, side="right")))
        yield batch.slice(first, stop - first)
        first = stop


def _counted(batch: pa.RecordBatch, term: Callable[[str], str | None] | None) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows of a batch whose last column are words, with their terms and, a row and term: the places of both and the number of uses.

    ``term`` makes a word a term, or null to leave it out; it is asked once for the equal words of these rows.
    """
    for part in portions(batch):
        sizes = pc.fill_null(pc.list_value_length(part.column(part.num_columns - 1)), 0).to_numpy()
        words = part.column(part.num_columns - 1).flatten().dictionary_encode()
        spelled = words.dictionary if term is None else pa.array([term(w) for w in words.dictionary.to_pylist()], pa.string())
        terms = spelled.dictionary_encode()
        code = pc.fill_null(terms.indices, -1).to_numpy()[words.indices.to_numpy()]
        row = np.repeat(np.arange(part.num_rows, dtype=np.int64), sizes)[code >= 0]
        base = max(1, len(terms.dictionary))
        pairs, n = np.unique(row * base + code[code >= 0], return_counts=True)
        yield part, terms.dictionary, pairs // base, pairs % base, n


def word_runs(files: DataFrame, words: Column, *keep: str, term: Callable[[str], str | None] | None = None) -> DataFrame:
    """(*keep, term, n): a file's distinct words, or what ``term`` makes of them, with their number, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, terms, row, at, n in _counted(batch, term):
                own = [part.column(i).take(pa.array(row)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, terms.take(pa.array(at)), pa.array(n, pa.int64())], names=[*keep, "term", "n"])

    held = files.select(*keep, words.alias("_words"))
    return held.mapInArrow(run, StructType([*held.schema.fields[:-1], StructField("term", StringType()), StructField("n", LongType())]))


def by_path(files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The files whose path stands once, and the rows of the paths that stand repeatedly (null is a path too); None if there are none."""
    twice = cut(files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("path").alias("again")))
    if twice.isEmpty():
        return files, None
    same = F.col("path").eqNullSafe(F.col("again"))
    return files.join(twice, same, "left_anti"), files.join(twice, same, "left_semi")


def _prose(files: DataFrame, *keep: str) -> DataFrame:
    """``files(text)`` with the words of its folded text as ``words``, before ``lexical.prose_term``."""
    return lexical.normalize_text(files.select(*keep, "text"), "text", form="FOLD").select(*keep, lexical.found_words(F.col("text")).alias("words"))


def _occurrences(files: DataFrame) -> DataFrame:
    return word_runs(_prose(files, "path"), F.col("words"), "path", term=lexical.prose_term).select("term", "path", "n")


def whole_doc_occurrences(files: DataFrame) -> DataFrame:
    """doc_occ of ``files(path, text)`` at rest: only the rows of repeated paths are grouped, the others are counted where they are read."""
    once, again = by_path(files)
    return _occurrences(once) if again is None else _occurrences(once).union(_occurrences(again).groupBy("term", "path").agg(F.sum("n").alias("n")))


def whole_doc_vocabulary(files: DataFrame) -> DataFrame:
    """``doc_vocabulary`` of ``files(path, text)``: tasks add the files up where they read them, so that no row a term and file leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, terms, row, at, n in _counted(batch, lexical.prose_term):
                uses = np.bincount(at, n, minlength=len(terms)).astype(np.int64)  # exact below 2^53
                paths = np.bincount(at[part.column(0).to_numpy(zero_copy_only=False)[row]], minlength=len(terms))
                yield pa.RecordBatch.from_arrays([terms, pa.array(uses), pa.array(paths, pa.int64())], names=["term", "uses", "files"])

    once, again = by_path(files)
    held = _prose(once.select(F.col("path").isNotNull().alias("has"), "text"), "has")
    rows = held.mapInArrow(run, "term string, uses long, files long")
    if again is not None:
        rows = rows.union(doc_vocabulary(_occurrences(again).groupBy("term", "path").agg(F.sum("n").alias("n"))))
    return rows.groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("files").alias("files"))


def doc_totals(files: DataFrame) -> DataFrame:
    """(path, words, terms) of files with words: their number and that of distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, row, _, n in _counted(batch, lexical.prose_term):
                words = np.bincount(row, n, minlength=part.num_rows).astype(np.int64)  # exact below 2^53
                terms = np.bincount(row, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(terms, pa.int64())], names=["path", "words", "terms"]).filter(pa.array(terms > 0))

    once, again = by_path(files)
    rows = _prose(once, "path").mapInArrow(run, "path string, words long, terms long")
    if again is not None:
        rows = rows.union(_occurrences(again).groupBy("term", "path").agg(F.sum("n").alias("n")).groupBy("path").agg(F.sum("n"), F.count("*")))
    return rows


def token_occurrences(ident_occ: DataFrame, limit: int = LIMITS["identifier_tokens"], wide: bool = True) -> DataFrame:
    """ident_occ with tokens, cut at ``limit``, and their number before the cut; spellings are split once each."""
    if wide:
        names = lexical.tokenize_distinct(ident_occ.select("name").distinct())
        split = ident_occ.join(names, "name")
    else:
        split = ident_occ.withColumn("tokens", lexical.tokens(F.col("name")))
    return split.withColumn("token_count", F.size("tokens").cast("long")).withColumn("tokens", F.slice("tokens", 1, limit))


def by_token(tok_occ: DataFrame) -> DataFrame:
    """One row per token position: token, name, path, module, language, n, origin."""
    rows = tok_occ.select("name", "path", "module", "language", "n", F.explode("tokens").alias("token"))
    return rows.withColumn("origin", lexical.token_origin(F.col("token"), F.col("language")))


def identifier_counts(ident_occ: DataFrame) -> DataFrame:
    return ident_occ.groupBy("name").agg(F.sum("n").alias("uses"), F.countDistinct("path").alias("files"))


def token_counts(tok_occ: DataFrame) -> DataFrame:
    """(token, uses, files, modules, origin): a repeated token in a name counts each time; domain wins over language."""
    domain = F.max(F.col("origin") == "domain").alias("domain")
    return path_totals(by_token(tok_occ).groupBy("token", "module", "path").agg(F.sum("n").alias("n"), domain))  # a path is of one module


def token_uses(tok_occ: DataFrame) -> DataFrame:
    """(token, uses, origin): ``token_counts`` where neither files nor modules are asked for, so tasks add up over both."""
    origin = F.when(F.max(F.col("origin") == "domain"), "domain").otherwise("language").alias("origin")
    return by_token(tok_occ).groupBy("token").agg(F.sum("n").alias("uses"), origin)


def path_totals(paths: DataFrame, *more: Column) -> DataFrame:
    """``token_counts`` of (token, module, path, n, domain), a row per token and path; ``more``: maxima to carry along. Null is no path and no module."""
    names = [f"_m{i}" for i in range(len(more))]
    return module_totals(paths.select("token", "module", "n", F.col("path").isNotNull().cast("long").alias("files"), "domain", *[c.alias(n) for c, n in zip(more, names, strict=True)]), *names)


def module_totals(rows: DataFrame, *names: str) -> DataFrame:
    """``path_totals`` of (token, module, n, files, domain, *names), of which several rows may be of one token and module."""
    modules = rows.groupBy("token", "module").agg(F.sum("n").alias("n"), F.sum("files").alias("files"), *[F.max(n).alias(n) for n in ("domain", *names)])
    origin = F.when(F.max("domain"), "domain").otherwise("language").alias("origin")
    return modules.groupBy("token").agg(F.sum("n").alias("uses"), F.sum("files").alias("files"), F.count("module").alias("modules"), origin, *[F.max(n).alias(n) for n in names])


def neighbour_uses(files: DataFrame, kept: Callable[[str], bool]) -> DataFrame:
    """(token, module, n, files, domain, named) of ``files(has, module, language, stem, w)``: the pairs of neighbouring words that hold a kept word.

    A word is in two pairs, the first and the last of a file in one. Tasks add files up where they read them. ``has``: whether a file counts as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, terms, row, at, n in _counted(batch, lambda w: w if kept(w) else None):
                modules = part.column(1).dictionary_encode(null_encoding="encode")
                place = lambda i: pc.fill_null(pc.index_in(part.column(i), value_set=terms), -1).to_numpy()[row]  # noqa: E731, B023
                n = 2 * n - (place(4) == at) - (place(5) == at)
                named, domain = place(3) == at, np.ones(len(at), bool)
                for language, own in lexical.BUILTINS.items():
                    spoken = pc.fill_null(pc.equal(part.column(2), language), False).to_numpy(zero_copy_only=False)
                    domain &= ~(spoken[row] & pc.is_in(terms, value_set=pa.array(own, terms.type)).to_numpy(zero_copy_only=False)[at])
                held, has = n > 0, part.column(0).to_numpy(zero_copy_only=False)[row]
                base = max(1, len(terms))
                key, group = np.unique((modules.indices.to_numpy()[row].astype(np.int64) * base + at)[held], return_inverse=True)
                total = lambda c: pa.array(np.bincount(group, c[held], minlength=len(key)).astype(np.int64))  # noqa: E731, B023
                some = lambda c: pc.greater(total(c), 0)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([terms.take(pa.array(key % base)), modules.dictionary.take(pa.array(key // base)), total(n), total(has), some(domain), some(named)], names=["token", "module", "n", "files", "domain", "named"])

    ends = files.select("has", "module", "language", "stem", F.get("w", 0).alias("a"), F.get("w", F.size("w") - 1).alias("z"), "w")
    return ends.mapInArrow(run, "token string, module string, n long, files long, domain boolean, named boolean")


def token_patterns(tok_occ: DataFrame) -> DataFrame:
    shaped = tok_occ.groupBy("tokens").agg(F.sum("n").alias("n")).select("n", F.explode(lexical.patterns(F.col("tokens"))).alias("p"))
    return shaped.groupBy(F.col("p.token").alias("token"), F.col("p.pattern").alias("pattern")).agg(F.sum("n").alias("uses"))


def neighbor_pairs(tok_occ: DataFrame, keys: list[str], only: DataFrame | None = None) -> DataFrame:
    """(a, b, *keys, uses): distinct tokens that share an identifier, both directions.

    Identifiers are added up before their pairs are made, and ``only(token)``
    restricts a before the pairs, so ubiquitous names cost their length squared
    once. At most 64 tokens a name.
    """
    d, a = F.array_distinct("tokens").alias("d"), F.explode("d").alias("a")
    if only is None:
        left = tok_occ.groupBy("tokens", *keys).agg(F.sum("n").alias("n")).select(*keys, "n", d).where(F.size("d") > 1).select(*keys, "n", "d", a)
    else:  # a bounded list, so identifiers without any of it leave before they are added up
        held = tok_occ.select(*keys, "n", d).where(F.size("d") > 1).select(*keys, "n", "d", a).join(F.broadcast(only.select(F.col("token").alias("a"))), "a", "left_semi")
        left = held.groupBy("a", "d", *keys).agg(F.sum("n").alias("n"))
    return left.select("a", F.explode("d").alias("b"), *keys, "n").where("a != b").groupBy("a", "b", *keys).agg(F.sum("n").alias("uses"))


def module_contexts(tok_occ: DataFrame, cap: int = LIMITS["module_contexts"], only: DataFrame | None = None) -> DataFrame:
    """(token, module, contexts, truncated): the number of distinct neighbours in a module, and whether it is over the cap."""
    pairs = neighbor_pairs(tok_occ, ["module"], only)
    return pairs.groupBy(F.col("a").alias("token"), "module").agg(F.count("*").alias("contexts")).withColumn("truncated", F.col("contexts") > cap)


def oversized(tok_occ: DataFrame, limit: int = LIMITS["identifier_tokens"]) -> DataFrame:
    return tok_occ.agg(F.countDistinct(F.when(F.col("token_count") > limit, F.col("name"))).alias("oversized"))


def doc_vocabulary(doc_occ: DataFrame) -> DataFrame:
    return doc_occ.groupBy("term").agg(F.sum("n").alias("uses"), F.count("path").alias("files"))  # doc_occ has a row per term and path
