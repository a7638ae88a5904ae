"""Import extraction and resolution into a module graph.

Resolution is a cascade of equality joins on precomputed keys (file name, path
suffix, directory suffix, stem, top-level name); the first that hits wins.
Every suffix of a path is a key, so no spec is compared with all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LIMITS
from ..functions.paths import module_of, name_of
from .topk import top_k

# Import statements per language; each pattern has one group, the imported name.
_JS = [r"\bfrom\s*['\"]([^'\"]+)['\"]", r"\bimport\s*['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"]
_C = [r"#include\s+[\"<]([^\">]+)[\">]"]
STATEMENTS = {
    "python": [r"(?m)^[ \t]*import\s+([\w.]+)", r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import"],
    "javascript": _JS,
    "typescript": _JS,
    "go": [r'(?m)^[ \t]*import\s+(?:\w+\s+)?"([^"]+)"'],
    "rust": [r"(?m)^[ \t]*(?:pub\s+)?use\s+([\w:]+)"],
    "ocaml": [r"(?m)^[ \t]*open\s+([\w.]+)", r"(?m)^[ \t]*include\s+([\w.]+)"],
    "java": [r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.]+)"],
    "kotlin": [r"(?m)^[ \t]*import\s+([\w.]+)"],
    "c": _C,
    "cpp": _C,
    "ruby": [r"(?m)^[ \t]*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"],
}
GO_BLOCK, GO_LINE = r"(?s)import\s*\(([^)(]*)\)", r'(?m)^[ \t]*(?:\w+\s+)?"([^"]+)"'
# What a relative JavaScript spec may leave out, in order of preference; others try the package's file.
JS_ENDINGS = ["", ".js", ".ts", ".tsx", ".jsx", ".mjs", ".cjs", "/index.js", "/index.ts"]


def extract(text: Column, language: Column) -> Column:
    """Imported names in pattern order, repeats kept."""
    out = None
    for lang, own in STATEMENTS.items():
        found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in own])
        if lang == "go":
            blocks = F.transform(F.regexp_extract_all(text, F.lit(GO_BLOCK), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(GO_LINE), F.lit(1)))
            found = F.concat(found, F.flatten(blocks))
        out = F.when(language == lang, found) if out is None else out.when(language == lang, found)
    return F.coalesce(out.otherwise(F.array().cast("array<string>")), F.array().cast("array<string>"))


def import_specs(files: DataFrame) -> DataFrame:
    """(path, language, spec, n) of ``files(path, language, text)``."""
    rows = files.select("path", "language", F.explode(extract(F.col("text"), F.col("language"))).alias("spec"))
    return rows.groupBy("path", "language", "spec").agg(F.count("*").alias("n"))


def _slug(path: Column) -> Column:
    return F.when(name_of(path).contains("."), F.regexp_replace(path, r"\.[^./]*$", "")).otherwise(path)


def _suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _prefixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


class Index:
    """Lookup keys of the code files; equal keys keep the path that comes first."""

    def __init__(self, files: DataFrame):
        paths = files.select("path").distinct()
        low_name = F.lower(name_of(F.col("path")))
        self.names = paths.groupBy(low_name.alias("k_name")).agg(F.min("path").alias("by_name"))
        slugs = paths.groupBy(_slug(F.col("path")).alias("slug")).agg(F.min("path").alias("path"))
        self.suffixes = slugs.select("path", F.explode(_suffixes(F.col("slug"))).alias("k_suffix")).groupBy("k_suffix").agg(F.min("path").alias("by_suffix"))
        self.stems = slugs.groupBy(F.lower(name_of(F.col("slug"))).alias("k_stem")).agg(F.min("path").alias("by_stem"))
        self.dirs = paths.select(F.explode(_prefixes(F.col("path"))).alias("dir")).distinct()
        self.dir_suffixes = self.dirs.select("dir", F.explode(_suffixes(F.col("dir"))).alias("k_dir")).groupBy("k_dir").agg(F.min("dir").alias("by_dir"))
        self.tops = paths.select(F.lower(F.regexp_replace(F.regexp_extract("path", "^([^/]*)", 1), r"\.[^.]*$", "")).alias("k_top")).distinct()
        self.modules = paths.select(module_of(F.col("path")).alias("module")).distinct()
        self.paths = paths


def _absolute(specs: DataFrame, index: Index) -> DataFrame:
    """Specs that don't start with a dot to (path, spec, n, target, external)."""
    rust = F.col("language") == "rust"
    spec = F.when(rust, F.regexp_replace("spec", "^crate::", "")).otherwise(F.col("spec"))
    whole = specs.withColumn("s", spec).withColumn("slug", F.regexp_replace(F.regexp_replace("s", r"\.|::", "/"), "/+$", ""))
    # Rust paths end in items: shorter and shorter heads are tried, the longest that hits wins.
    parts = F.split("slug", "/")
    heads = F.when(rust, F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array("slug"))
    tried = whole.select("*", F.posexplode(heads).alias("turn", "head"))
    tried = tried.withColumn("k_name", F.when((F.col("turn") == 0) | rust, F.lower(name_of(F.when(F.col("turn") == 0, F.col("s")).otherwise(F.col("head")))))).withColumn("k_suffix", F.col("head")).withColumn("k_dir", F.when(rust | F.col("head").contains("/"), F.col("head"))).withColumn("k_stem", F.lower(name_of(F.col("head"))))
    first = F.regexp_extract(F.regexp_replace("s", "::", "."), r"^([^./]*)", 1)
    tried = tried.withColumn("first", first).withColumn("k_top", F.lower("first"))
    for keys in (index.names, index.suffixes, index.dir_suffixes, index.stems):
        tried = tried.join(keys, keys.columns[0], "left")
    tried = tried.join(index.tops.withColumn("is_top", F.lit(True)), "k_top", "left")
    hit = F.coalesce(module_of(F.col("by_name")), module_of(F.col("by_suffix")), F.col("by_dir"), module_of(F.col("by_stem")))
    best = tried.withColumn("hit", hit).groupBy("path", "language", "spec", "n", "s", "first").agg(F.min(F.when(F.col("hit").isNotNull(), F.struct("turn", "hit"))).alias("b"), F.max("is_top").alias("is_top"))
    target = F.when(F.col("s") == "crate", F.lit(None)).otherwise(F.coalesce("b.hit", F.when(F.col("is_top"), F.lower("first"))))
    outside = target.isNull() & ~((F.col("language") == "rust") & (F.col("s") == "crate")) & (F.col("first") != "")
    return best.select("path", "spec", "n", target.alias("target"), F.when(outside, F.col("first")).alias("external"))


def _relative(specs: DataFrame, index: Index) -> DataFrame:
    """Specs of dots, and Rust's self and super, joined to the importer's directory; unknown targets give no edge."""
    rust, python = F.col("language") == "rust", F.col("language") == "python"
    inside = F.when(F.col("path").contains("/"), module_of(F.col("path"))).otherwise("")
    stem = F.regexp_replace(name_of(F.col("path")), r"\.[^.]*$", "")
    # A Rust file other than mod, lib or main is a module of its own beneath its directory.
    home = F.when(rust & ~stem.isin("mod", "lib", "main"), F.concat_ws("/", F.when(inside != "", inside), stem)).otherwise(inside)
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    tail = F.when(python, F.regexp_replace(F.regexp_replace("spec", r"^\.+", ""), r"\.", "/")).when(rust, F.regexp_replace(F.regexp_replace("spec", "super", ".."), "::", "/")).otherwise(F.col("spec"))
    tail = F.when(rust, F.regexp_replace(tail, "(^|/)self(?=/|$)", "$1.")).otherwise(tail)
    ups = F.when(python, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))).otherwise("")
    raw = F.split(F.concat(home, F.lit("/"), ups, tail), "/")
    walked = F.aggregate(raw, F.array().cast("array<string>"), lambda a, p: F.when((p == "") | (p == "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    asked = specs.withColumn("walked", walked).withColumn("base", F.array_join("walked", "/"))
    endings = F.when(F.col("language").isin("javascript", "typescript"), F.array(*[F.lit(e) for e in JS_ENDINGS])).when(python, F.array(F.lit(".py"), F.lit("/__init__.py"), F.lit(".pyi"))).when(rust, F.array(F.lit(".rs"), F.lit("/mod.rs"))).otherwise(F.array(F.lit(""), F.lit(".rb"), F.lit(".h"), F.lit(".c")))
    n = F.size("walked")
    heads = F.when(rust & (n > 0), F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice("walked", F.lit(1), i), "/"))).otherwise(F.array("base"))
    tried = asked.select("*", F.posexplode(heads).alias("turn", "head")).select("*", F.posexplode(endings).alias("pref", "end")).withColumn("file", F.concat("head", "end"))
    files = index.paths.select(F.col("path").alias("file"), module_of(F.col("path")).alias("at"))
    found = tried.join(files, "file", "left").groupBy("path", "language", "spec", "n", "base").agg(F.min(F.when(F.col("at").isNotNull(), F.struct("turn", "pref", "at"))).alias("b"))
    mods = index.modules.select(F.when(F.col("module") == ".", "").otherwise(F.col("module")).alias("base"), F.col("module").alias("is_module"))
    return found.join(mods, "base", "left").select("path", "spec", "n", F.coalesce("b.at", "is_module").alias("target"), F.lit(None).cast("string").alias("external"))


def resolve(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, spec, n, target, external): the module a spec names inside the corpus, or the outside name."""
    index = Index(files)
    relative = F.col("spec").startswith(".") | ((F.col("language") == "rust") & F.col("spec").rlike("^(self|super)(::|$)"))
    return _absolute(specs.where(~relative), index).unionByName(_relative(specs.where(relative), index))


def internal_edges(resolved: DataFrame, cap: int | None = LIMITS["edges"]) -> DataFrame:
    """(src, dst, uses) between different modules."""
    src = module_of(F.col("path"))
    edges = resolved.where(F.col("target").isNotNull() & (F.col("target") != src)).groupBy(src.alias("src"), F.col("target").alias("dst")).agg(F.sum("n").alias("uses"))
    return edges if cap is None else top_k(edges, cap, F.desc("uses"), F.asc("src"), F.asc("dst"))


def external_tally(resolved: DataFrame, cap: int | None = LIMITS["external"]) -> DataFrame:
    names = resolved.where("external is not null").groupBy(F.col("external").alias("name")).agg(F.sum("n").alias("uses"))
    return names if cap is None else top_k(names, cap, F.desc("uses"), F.asc("name"))


def degrees(edges: DataFrame) -> DataFrame:
    """(module, fan_in, fan_out, weight): distinct importers and imported modules, and uses received."""
    into = edges.groupBy(F.col("dst").alias("module")).agg(F.countDistinct("src").alias("fan_in"), F.sum("uses").alias("weight"))
    out = edges.groupBy(F.col("src").alias("module")).agg(F.countDistinct("dst").alias("fan_out"))
    return into.join(out, "module", "full").select("module", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out", "weight")])
