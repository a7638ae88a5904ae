"""Fixed values of the lexical rules: word lists, extensions, names and patterns, as plain text."""

# Words of syntax, which no vocabulary keeps.
KEYWORDS = """
    and as assert async auto await begin bool break case catch char class const constraint continue def default
    del delete do double elif else end enum except exec extends extern false final finally float for fn from fun
    func function functor global goto if impl implements import in inherit instanceof int interface is lambda let
    long method mod module mutable new nil none nonlocal not null object or package pass print println private
    protected pub public raise rec ref require return self short signed sizeof some static str string struct super
    switch then this throw trait true try typedef typeof union unsigned use val var virtual void volatile when
    while with yield
""".split()

# Words of prose that name nothing.
STOPWORDS = """
    a about after all also an and any are as at be been before being between but by can could did do does done
    during each for from had has have he her here his how if in into is it its just may might more most must no not of on
    one only or other our over own per same should she so some such than that the their them then there these
    they this those through to two under use used using via was we were what when where which who whom whose why
    will with within without would yes you your new i
""".split()

# Builtins that belong to a language rather than to a project.
BUILTINS = {"python": "append bytearray callable classmethod delattr dict divmod enumerate frozenset getattr hasattr isinstance issubclass len memoryview repr reversed setattr sorted staticmethod tuple".split()}

# Languages by file extension, and the extensions of documentation.
LANGUAGES = {
    "python": "py pyi", "javascript": "js mjs cjs jsx", "typescript": "ts tsx", "go": "go", "rust": "rs", "java": "java",
    "kotlin": "kt kts", "scala": "scala", "c": "c h", "cpp": "cpp cc cxx hpp", "ruby": "rb", "csharp": "cs", "swift": "swift",
    "php": "php", "ocaml": "ml mli", "haskell": "hs", "elixir": "ex exs", "erlang": "erl", "clojure": "clj", "lua": "lua",
    "shell": "sh bash zsh", "perl": "pl", "r": "r", "julia": "jl", "zig": "zig", "nim": "nim", "dart": "dart", "sql": "sql",
    "vue": "vue", "svelte": "svelte",
}
EXTENSIONS = {e: lang for lang, own in LANGUAGES.items() for e in own.split()}
DOC_EXTENSIONS = "md rst txt adoc".split()

# Names of files whose content is never read.
SENSITIVE = r"(\.env$|\.env\.|\.(pem|key|p12|pfx|jks|keystore|der|p8|ppk|kdbx|asc|gpg|pgp)$|^id_(rsa|dsa|ecdsa|ed25519)$|^\.(netrc|npmrc|pypirc|htpasswd|dockercfg)$|secret|credential)"

# Directory names that give a path its default role, strongest first.
ROLE_DIRS = {
    "vendored": "_opam deps env node_modules third-party third_party vendor vendored venv".split(),
    "generated": "__pycache__ _build build coverage dist generated autogenerated auto_generated out target".split(),
    "fixture": "fixture fixtures testdata test_data __snapshots__".split(),
    "test": "test tests spec specs __tests__".split(),
}
ROLES = ("production", "test", "fixture", "generated", "vendored")

# Limits of the compatible mode.
LIMITS = {
    "file_bytes": 2_000_000, "corpus_bytes": 32_000_000, "source_files": 10_000, "walk_entries": 100_000, "directory_entries": 10_000,
    "tokens": 5_000, "identifiers": 2_000, "doc_terms": 2_000, "locations": 5, "identifier_tokens": 64, "edges": 200, "external": 30,
    "pair_top": 150, "module_contexts": 30, "overload_modules": 50, "groups": 50, "group_members": 6, "member_tokens": 2_000, "graph_label_chars": 5_000_000, "god_nodes": 8, "label_chars": 512,
    "findings": 10, "compound_tokens": 32,
    "glossary_concepts": 10_000, "glossary_aliases": 50_000, "glossary_bindings": 50_000, "config_rules": 500, "path_chars": 512, "json_bytes": 64_000_000, "graph_refs": 1_000_000,
}
