"""Path predicates and classes as columns: globs, filters, languages, artifacts, categories, test pairs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File classes.
LANGUAGES = {
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "scala": "scala", "cs": "csharp", "js": "javascript",
    "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "c": "c_cpp", "h": "c_cpp", "cc": "c_cpp", "cpp": "c_cpp", "hpp": "c_cpp", "rb": "ruby",
    "php": "php", "swift": "swift", "lua": "lua", "sh": "shell", "sql": "sql", "md": "markdown", "rst": "rst", "adoc": "asciidoc", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "json": "json", "html": "html", "css": "css",
}
NAMES = {"Makefile": "make", "Dockerfile": "docker", "CMakeLists.txt": "cmake", "justfile": "just", "BUILD": "bazel", "WORKSPACE": "bazel"}
BUILD_FILES = ["Makefile", "CMakeLists.txt", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Jenkinsfile", "Taskfile.yml", "pyproject.toml"]
CONFIG_EXTENSIONS = ["yaml", "yml", "json", "toml", "cfg", "ini", "xml", "env", "properties"]
DOC_EXTENSIONS = ["md", "rst", "txt", "adoc"]
BARRELS = ["__init__.py", "index.js", "index.ts", "index.tsx", "index.jsx", "mod.rs"]
DIFF_BUILD = [
    "makefile", "cmakelists.txt", "meson.build", "build.gradle", "build.gradle.kts", "pom.xml", "build.sbt", "cargo.toml", "go.mod", "package.json",
    "pyproject.toml", "setup.py", "setup.cfg", ".eslintrc", ".prettierrc", "tsconfig.json", "dockerfile", "docker-compose.yml", "docker-compose.yaml",
]
DIFF_CONFIG = ["yml", "yaml", "toml", "ini", "cfg", "env", "json", "xml"]
DIFF_DOCS = ["/docs/", "/doc/", "readme", "changelog", "license", "contributing"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last point of the name; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def language_family(path: Column) -> Column:
    by_name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    by_extension = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(by_name, basename(path)), F.element_at(by_extension, extension(path)))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression to be found in a path.

    `**/` is any number of folders, `**` anything, `*` and `?` stay within a
    name, classes may begin with `!`. A glob with a leading slash or `**` holds
    for the whole path, one with another slash for its end, others for the name.
    """
    token = re.compile(r"(?P<dirs>\*\*/)|(?P<all>\*\*)|(?P<any>\*)|(?P<one>\?)|(?P<set>\[[!^]?\]?[^\]]*\])|(?P<text>.)", re.S)
    fixed = {"dirs": "(?:.+/)?", "all": ".*", "any": "[^/]*", "one": "[^/]"}
    body = ""
    for m in token.finditer(glob):
        x = m[0]
        body += fixed.get(m.lastgroup) or (re.escape(x) if m.lastgroup == "text" else "[^" + x[2:] if x[1] == "!" else x)
    if glob.startswith("/") or glob.startswith("**/") or glob == "**":
        return f"^{body}$"
    return f"(?:^|.*/){body}$" if "/" in glob else f"(?:^|/){body}$"


def matches_glob(path: Column, *globs: str) -> Column:
    """Whether any of the globs matches: one expression over the path."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def matches_filter(path: Column, filters: list[str]) -> Column:
    """Equal to a filter, below it as a folder, or matched by it as a glob."""
    if not filters:
        return F.lit(True)
    one = [(path == p) | path.startswith(p.rstrip("/") + "/") | (matches_glob(path, p) if re.search(r"[*?\[]", p) else F.lit(False)) for p in filters]
    return reduce(lambda a, b: a | b, one)


def included(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    return (matches_glob(path, *include) if include else F.lit(True)) & ~(matches_glob(path, *exclude) if exclude else F.lit(False))


def is_test(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?/") | basename(path).startswith("test_") | basename(path).endswith("_test.py")


def is_barrel(path: Column) -> Column:
    return basename(path).isin(BARRELS)


def artifact(path: Column) -> Column:
    """test, build, config, doc or code, the first that holds."""
    return (
        F.when(is_test(path), "test").when(basename(path).isin(BUILD_FILES), "build").when(extension(path).isin(CONFIG_EXTENSIONS), "config")
        .when(extension(path).isin(DOC_EXTENSIONS), "doc").otherwise("code")
    )


def diff_category(path: Column) -> Column:
    """test, build, config (of the root only), docs or prod."""
    low = F.lower(path)
    docs = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in DIFF_DOCS]) | extension(path).isin(DOC_EXTENSIONS)
    root = ~F.contains(F.regexp_replace(path, r"^([^.]*)\.", "$1"), F.lit("/"))
    return (
        F.when(is_test(path), "test").when(basename(low).isin(DIFF_BUILD), "build").when(extension(path).isin(DIFF_CONFIG) & root, "config")
        .when(docs, "docs").otherwise("prod")
    )


def rename_certainty(tier: Column, certainty: Column) -> Column:
    return F.when(tier.isin("proven", "strong"), "high").when(tier == "anchored", "medium").otherwise(F.when(certainty == "certain", "high").otherwise("low"))


def test_pairs(path: Column) -> Column:
    """Paths at which the tests of a Python file may be: array, empty for other files."""
    name, folder = basename(path), F.regexp_replace(path, "/?[^/]*$", "")
    sub = F.regexp_replace(folder, "^[^/]*/?", "")
    candidates = F.array(
        F.concat(F.lit("tests/"), F.when(sub != "", F.concat(sub, F.lit("/"))).otherwise(F.lit("")), F.lit("test_"), name),
        F.concat(F.lit("tests/test_"), name),
        F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(F.lit("")), F.lit("test_"), name),
    )
    return F.when(path.endswith(".py") & ~is_test(path), F.array_distinct(candidates)).otherwise(F.array().cast("array<string>"))


def module_of(path: Column) -> Column:
    """Dotted module of a path: source roots, extension and package files dropped."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "^(src|lib|app)/", "")
    return F.translate(F.regexp_replace(plain, "/__init__$", ""), "/", ".")


def prefixes(name: Column, separator: str = ".") -> Column:
    """A dotted name and all its parents, longest first."""
    parts = F.split(name, re.escape(separator))
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def tree_distance(a: Column, b: Column) -> Column:
    """Steps between two files' folders in the tree."""
    x, y = F.split(F.regexp_replace(a, "/?[^/]*$", ""), "/"), F.split(F.regexp_replace(b, "/?[^/]*$", ""), "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce((p == q).cast("int"), F.lit(0)))
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(1).alias("on")), lambda s, e: F.struct((s["n"] + s["on"] * e).alias("n"), (s["on"] * e).alias("on")), lambda s: s["n"])
    return (F.size(x) + F.size(y) - 2 * shared).cast("long")
