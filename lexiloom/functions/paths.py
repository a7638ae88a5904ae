"""Path columns: modules, roles, prefixes and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed import DOC_EXTENSIONS, EXTENSIONS, ROLE_DIRS, SENSITIVE


def module_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), ".")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"[^.]\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.element_at(table, extension_of(path))


def kind_of(path: Column) -> Column:
    return F.when(language_of(path).isNotNull(), "code").when(extension_of(path).isin(DOC_EXTENSIONS), "doc")


def is_sensitive(path: Column) -> Column:
    return F.lower(name_of(path)).rlike(SENSITIVE)


def default_role(path: Column) -> Column:
    """vendored, generated, fixture or test by directory or file name; else production."""
    low = F.lower(path)
    parts = F.split(low, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = name_of(low)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    inside = lambda role: F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in ROLE_DIRS[role]]))
    named_test = stem.isin("conftest") | stem.startswith("test_") | stem.rlike("_tests?$") | name.contains(".test.") | name.contains(".spec.")
    return (
        F.when(inside("vendored"), "vendored")
        .when(inside("generated") | name.contains(".generated.") | stem.endswith("_generated"), "generated")
        .when(inside("fixture"), "fixture")
        .when(inside("test") | named_test, "test")
        .otherwise("production")
    )


def under(path: Column, prefix: Column) -> Column:
    """Whether a path is the prefix or lies beneath it."""
    return (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def in_scope(path: Column, prefixes: Column) -> Column:
    """Null prefixes: the whole repository."""
    return prefixes.isNull() | F.exists(prefixes, lambda p: under(path, p))


def scopes_overlap(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | F.exists(a, lambda x: F.exists(b, lambda y: under(x, y) | under(y, x)))


def with_roles(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files(path)`` with role: the longest configured prefix wins, else the default.

    ``rules(prefix, role)`` is small by contract (at most 500). Every path meets
    its own prefixes by an equality join, so the cost follows the path depth.
    """
    parts = F.split("path", "/")
    prefixes = files.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("prefix"))
    hit = prefixes.join(rules, "prefix").groupBy("path").agg(F.max_by("role", F.length("prefix")).alias("configured"))
    return files.join(hit, "path", "left").withColumn("role", F.coalesce("configured", default_role(F.col("path")))).drop("configured")
