"""How much there is of what: files, bytes and words by module, role, kind and language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The groupings of ``inventory``, by name.
LEVELS = {"all": [], "kind": ["kind"], "role": ["role", "kind"], "language": ["language", "kind"], "module": ["module", "kind"], "module_role": ["module", "role", "kind"], "module_language": ["module", "language", "kind"]}
_COLUMNS = ["module", "role", "kind", "language"]


def inventory(files: DataFrame) -> DataFrame:
    """(level, module, role, kind, language, files, bytes, words) of ``files(module, role, kind, language, size, words)``.

    One pass with grouping sets; columns that a level doesn't group by are null.
    Null sizes and words count as none. An empty table has the level ``all`` alone.
    """
    sets = [[F.col(c) for c in own] for own in LEVELS.values()]
    # A bit a column, set where a set leaves it out.
    mask = {sum(1 << (len(_COLUMNS) - 1 - i) for i, c in enumerate(_COLUMNS) if c not in own): name for name, own in LEVELS.items()}
    level = F.create_map(*[F.lit(x) for pair in mask.items() for x in pair])
    plain = files.select(*_COLUMNS, F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("words", F.lit(0)).cast("long").alias("words"))
    got = plain.groupingSets(sets, *[F.col(c) for c in _COLUMNS]).agg(F.grouping_id().cast("int").alias("mask"), F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return got.select(level[F.col("mask")].alias("level"), *_COLUMNS, "files", "bytes", "words")


def _counters(rows: DataFrame, by: str, key: str, count: str, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(count))))).alias(name))


def module_inventory(made: DataFrame) -> DataFrame:
    """(module, code_files, code_bytes, languages, code_files_by_role, production), a row per module with code, of an ``inventory``.

    ``languages`` counts files by language, without files of none; ``production``: it holds a production file. Maps have a key per role or language.
    """
    code = made.where("kind = 'code' and module is not null")
    total = code.where("level = 'module'").select("module", F.col("files").alias("code_files"), F.col("bytes").alias("code_bytes"))
    roles = code.where("level = 'module_role' and role is not null")
    languages = code.where("level = 'module_language' and language is not null")
    production = roles.where("role = 'production'").select("module", F.lit(True).alias("production"))
    out = total.join(_counters(languages, "module", "language", "files", "languages"), "module", "left").join(_counters(roles, "module", "role", "files", "code_files_by_role"), "module", "left").join(production, "module", "left")
    return out.withColumn("production", F.coalesce("production", F.lit(False)))


def totals(made: DataFrame) -> DataFrame:
    """One row of an ``inventory``: files, bytes, code_files, code_bytes, doc_files, doc_words, and files by role and kind as maps."""
    pick = lambda kind, c: F.coalesce(F.max(F.when((F.col("level") == "kind") & (F.col("kind") == kind), F.col(c))), F.lit(0)).alias(f"{kind}_{c}")
    one = made.agg(F.coalesce(F.max(F.when(F.col("level") == "all", F.col("files"))), F.lit(0)).alias("files"), F.coalesce(F.max(F.when(F.col("level") == "all", F.col("bytes"))), F.lit(0)).alias("bytes"), pick("code", "files"), pick("code", "bytes"), pick("doc", "files"), pick("doc", "words"))
    for kind in ("code", "doc"):
        rows = made.where(f"level = 'role' and kind = '{kind}' and role is not null").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "files")))).alias(f"{kind}_files_by_role"))
        one = one.join(rows)  # one row each
    return one
