"""Lexical column builders: identifiers, tokens, prose words, styles and folding.

Everything is a native expression for ASCII text. Text beyond ASCII needs NFKC
and full case folding, which no built-in has: ``tokenize_distinct`` runs an
Arrow UDF over the distinct spellings only and joins back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import BUILTINS, KEYWORDS, STOPWORDS

# Word shapes. Joiners U+200C and U+200D continue a word. What can't be part of what follows is not given back
# (++, *+), and the commonest characters have a class of their own that is asked first; neither changes what is found.
CONTINUES = r"[\p{L}\p{M}\p{N}_\x{200c}\x{200d}]"
IDENTIFIER = rf"(?:[\p{{L}}_]{CONTINUES}*)"
LETTERS = r"[a-z\p{L}][[a-z][\p{L}\p{M}\x{200c}\x{200d}]]*+"
PROSE = rf"{LETTERS}(?:['’]{LETTERS})*+"
CASE_SPLIT = r"[A-Z]{2,}s(?![a-z])|[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[0-9]+"
STRUCTURED = ("snake_case", "camelCase", "PascalCase", "UPPER_SNAKE", "kebab-case")
_PY_CASE_SPLIT = re.compile(CASE_SPLIT)
_PY_HUNKS = regex.compile(r"[\p{L}\p{M}\p{N}‌‍]+")
_DROPPED, _STOPPED = frozenset([*KEYWORDS, *STOPWORDS]), frozenset(STOPWORDS)
LEAST_TOKEN, LEAST_PROSE = 2, 3


def words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(set(words))])


#: Characters that every normal form leaves alone and that ``fold`` folds as Python does: ASCII, Latin letters up to
#: U+0131 but for the compatibility characters, basic Greek and Cyrillic, common punctuation, kana and CJK ideographs.
SETTLED = r"^[[\x00-\x7F][\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\x{0131}\x{0391}-\x{03A1}\x{03A3}-\x{03A9}\x{03AC}-\x{03AF}\x{03B1}-\x{03CE}\x{0410}-\x{044F}\x{2013}\x{2014}\x{2018}-\x{201E}\x{2020}-\x{2022}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}]]*$"


def fold(c: Column) -> Column:
    """Case folding of settled text: lower case, sharp s as ss, and one sigma."""
    return F.replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def is_settled(c: Column) -> Column:
    """Whether a text is known to be in every normal form, by its characters alone."""
    return (F.octet_length(c) == F.char_length(c)) | c.rlike(SETTLED)


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def identifiers(text: Column, language: Column | None = None) -> Column:
    """Identifier spellings in order, repeats kept; Clojure joins inner hyphens. Keywords and one-letter names drop."""
    plain = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    found = plain
    if language is not None:
        found = F.when(language == "clojure", F.regexp_extract_all(text, F.lit(rf"{IDENTIFIER}(?:-{IDENTIFIER})*"), F.lit(0))).otherwise(plain)
    return F.filter(found, lambda w: (F.length(w) >= LEAST_TOKEN) & ~fold(w).isin(KEYWORDS))


def term_words(name: Column) -> Column:
    """All words of a term, folded, before any filter: the identity of the term (ASCII)."""
    return F.transform(F.regexp_extract_all(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(CASE_SPLIT), F.lit(0)), F.lower)


def tokens(name: Column) -> Column:
    """The vocabulary tokens of an ASCII identifier or term."""
    return F.filter(term_words(name), lambda w: (F.length(w) >= LEAST_TOKEN) & ~w.rlike("^[0-9]+$") & ~w.isin(sorted(_DROPPED)))


def found_words(text: Column) -> Column:
    """The words of a normalised text in order, folded, before any filter."""
    # In ASCII a letter is one of a to z, whose class is read several times as fast.
    return F.when(F.octet_length(text) == F.char_length(text), F.regexp_extract_all(F.lower(text), F.lit("[a-z]++(?:'[a-z]++)*+"), F.lit(0))).otherwise(F.regexp_extract_all(fold(text), F.lit(PROSE), F.lit(0)))


def doc_words(text: Column) -> Column:
    """Prose words of a normalised text in order: folded, possessives cut, three letters or more, no stopwords."""
    bare = F.transform(found_words(text), lambda w: F.when(w.endswith("'s") | w.endswith("’s"), F.left(w, F.char_length(w) - 2)).otherwise(w))
    return F.filter(bare, lambda w: (F.length(w) >= LEAST_PROSE) & ~w.isin(STOPWORDS))


def prose_term(word: str) -> str | None:
    """What ``doc_words`` makes of a found word; null where it leaves it out."""
    bare = word[:-2] if word.endswith(("'s", "’s")) else word
    return bare if len(bare) >= LEAST_PROSE and bare not in _STOPPED else None


def token_origin(token: Column, language: Column) -> Column:
    out = F.lit(False)
    for lang, own in BUILTINS.items():
        out = out | ((language == lang) & token.isin(own))
    return F.when(F.coalesce(out, F.lit(False)), "language").otherwise("domain")


def identifier_style(name: Column) -> Column:
    core = F.regexp_replace(name, "^_+|_+$", "")
    upper = core.rlike(r"^(?=.*\p{Lu})[^\p{Ll}]*$")
    return (
        F.when(F.regexp_replace(core, "^-+|-+$", "").contains("-"), "kebab-case")
        .when(core.contains("_"), F.when(upper, "UPPER_SNAKE").otherwise("snake_case"))
        .when(upper, "upper")
        .when(core.rlike(r"^\p{Lu}"), F.when(core.rlike(r"\p{Ll}"), "PascalCase").otherwise("upper"))
        .when(core.rlike(r"\p{Lu}"), "camelCase")
        .otherwise("flat")
    )


def patterns(toks: Column) -> Column:
    """One substitution shape per position of two or more tokens: struct(token, pattern)."""
    at = F.sequence(F.lit(1), F.size(toks))
    one = lambda i: F.struct(F.element_at(toks, i).alias("token"), F.array_join(F.concat(F.slice(toks, F.lit(1), i - 1), F.array(F.lit("*")), F.slice(toks, i + 1, F.size(toks))), "_").alias("pattern"))
    return F.when(F.size(toks) >= 2, F.transform(at, one)).otherwise(F.array().cast("array<struct<token:string,pattern:string>>"))


# Spellings beyond ASCII, in Python.


def _kinds(word: str) -> list[str]:
    out: list[str] = []
    for c in word:
        if unicodedata.category(c)[0] == "M" or c in "‌‍":
            out.append(out[-1] if out else "other")
        elif c.isdigit():
            out.append("digit")
        else:
            out.append("upper" if c.isupper() else "lower" if c.islower() else "other")
    return out


def split_words(hunk: str) -> list[str]:
    """Words of one run of word characters, by changes of case, digits and script case."""
    if hunk.isascii():
        return _PY_CASE_SPLIT.findall(hunk)
    k = _kinds(hunk)
    cuts = [0]
    for i in range(1, len(hunk)):
        pair, ahead = (k[i - 1], k[i]), k[i + 1 : i + 3]
        starts_word = k[i] == "upper" and pair[0] != "upper"
        ends_acronym = pair == ("upper", "upper") and ahead == ["lower", "lower"]
        after_digits = pair[0] == "digit" and k[i] != "digit"
        cased_meets_uncased = (pair[0] == "other") != (k[i] == "other") and "digit" not in pair
        if starts_word or ends_acronym or after_digits or cased_meets_uncased:
            cuts.append(i)
    return [hunk[a:b] for a, b in zip(cuts, [*cuts[1:], len(hunk)], strict=True)]


def fold_text(word: str) -> str:
    return word.lower() if word.isascii() else unicodedata.normalize("NFKC", word).casefold()


def split_term(name: str) -> list[str]:
    name = name if name.isascii() else unicodedata.normalize("NFKC", name)
    return [fold_text(w) for hunk in _PY_HUNKS.findall(name.replace("_", " ")) for w in split_words(hunk)]


def split_tokens(name: str) -> list[str]:
    return [w for w in split_term(name) if len(w) >= LEAST_TOKEN and not w.isdigit() and w not in _DROPPED]


def tokenize_distinct(names: DataFrame, col: str = "name", out: str = "tokens", keep_all: bool = False) -> DataFrame:
    """``names`` with an array of tokens (or of all term words): native for ASCII, an Arrow UDF for the distinct others."""
    split = split_term if keep_all else split_tokens
    plain = names.where(is_ascii(F.col(col)) | F.col(col).isNull()).withColumn(out, (term_words if keep_all else tokens)(F.col(col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([split(n) for n in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["wide_name", out])

    wide = names.where(~is_ascii(F.col(col)))
    learned = wide.select(F.col(col).alias("wide_name")).distinct().mapInArrow(run, f"wide_name string, {out} array<string>")
    return plain.unionByName(wide.join(learned, F.col(col) == F.col("wide_name")).drop("wide_name"))


def normalize_text(texts: DataFrame, col: str, form: str = "NFKC") -> DataFrame:
    """A Unicode normal form (NFC, NFKC, or FOLD: NFKC, then case folding) for the rows that may need it; settled rows are not sent to Python."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        if form == "FOLD":  # folding can undo the form, and the form the folding
            return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()))
        return s.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    # One pass: settled texts meet the function as nulls and stay as they are.
    marked = texts.withColumn("_settled", is_settled(F.col(col)) | F.col(col).isNull())
    return marked.withColumn(col, F.when(F.col("_settled"), F.col(col)).otherwise(normal(F.when(~F.col("_settled"), F.col(col))))).drop("_settled")


def register(spark: SparkSession) -> None:
    """SQL-callable helpers: tokenize_identifier(name) and term_words(name) for any script."""

    @F.pandas_udf("array<string>")
    def tokenize_identifier(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else split_tokens(x))

    @F.pandas_udf("array<string>")
    def all_words(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else split_term(x))

    spark.udf.register("tokenize_identifier", tokenize_identifier)
    spark.udf.register("term_words", all_words)


def tokenization_contract() -> dict:
    return {"unicode_normalization": "NFKC+casefold", "identifier_characters": "Unicode-word; nonnumeric-start", "acronyms": "preserved-run", "digits": "suffix-to-preceding-word; standalone-dropped", "forms": ["camelCase", "PascalCase", "snake_case", "clojure-kebab-case"], "parser_backed": False}
