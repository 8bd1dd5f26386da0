"""Identifier and text functions as columns: word splits, phrases, signatures, hashes, task fields, cross references, endpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns with a meaning of their own, as others use them.
INTENTS = {
    "debug": ["bug", "fix", "error", "crash", "broken", "fail", "failing", "wrong", "issue", "debug", "trace", "traceback", "exception", "stacktrace", "investigate", "diagnose"],
    "implement": ["add", "implement", "create", "build", "introduce", "support", "feature", "extend", "enable", "integrate", "wire"],
    "refactor": ["refactor", "rename", "move", "extract", "split", "merge", "consolidate", "simplify", "clean", "reorganize", "restructure", "decouple", "inline"],
    "understand": ["understand", "explain", "how", "what", "where", "why", "find", "locate", "show", "describe", "document", "reads", "overview", "architecture"],
    "test": ["test", "tests", "testing", "coverage", "spec", "assertion", "mock", "fixture", "pytest", "unittest"],
}
STACKTRACE = [
    "traceback", "stacktrace", "stack trace", "exception", "error", "raise", "raised", "traceback:", "errno", "oserror", "typeerror", "valueerror", "keyerror",
    "attributeerror", "importerror", "runtimeerror", "indexerror", "filenotfounderror", "nameerror", "zerodivisionerror", "assertionerror", "notimplementederror",
    "connectionerror", "timeouterror", "permissionerror",
]
TEST_DRIVEN = [
    "write tests", "add tests", "test coverage", "missing tests", "increase coverage", "unit tests", "test cases", "integration tests", "parametrize", "pytest",
    "fixture", "mock", "assert",
]
NEGATIONS = r"(?i)\b(?:not|exclude|except|without|ignore|skip|excluding|except for)\s+(\S+)"
CROSS_REFERENCES = [
    (r":(?:func|class|meth|attr|mod|data|const|exc|obj):`~?([^`]+)`", "high"),
    (r"[Ss]ee\s+(?:also\s+)?[`:]*([A-Z][A-Za-z0-9_.]+)", "high"),
    (r"\[([A-Z][A-Za-z0-9_.]+)\]\(", "high"),
    (r"\[([A-Z][A-Za-z0-9_.]+)\]\[\]", "high"),
    (r"(?:^|\s)#([A-Z][A-Za-z0-9_.]+)", "high"),
    (r"(?:Returns?|Raises?|Yields?|Args?):\s*([A-Z][A-Za-z0-9_.]+)", "high"),
    (r"(?<!\w)([a-z_][a-z0-9_]*(?:\.[A-Z][A-Za-z0-9_]*)+)(?!\w)", "medium"),
    (r"(?<![A-Za-z])([A-Z][a-z]+(?:[A-Z][a-z]+)+)(?![A-Za-z])", "low"),
]
# (pattern, place of the method, place of the URL); without a method, any or GET
SERVER_ENDPOINTS = {
    "python": [
        (r"""(?i)@\w+\.(route|get|post|put|delete|patch|head|options)\(\s*['"]([^'"]+)['"]""", 1, 2),
        (r"""(?i)path\(\s*['"]([^'"]+)['"]""", None, 1),
        (r"""APIRouter\([^)]*prefix\s*=\s*['"]([^'"]+)['"]""", None, 1),
    ],
    "javascript": [
        (r"""(?i)\.(get|post|put|delete|patch|all)\(\s*['"`]([^'"`]+)['"`]""", 1, 2),
        (r"""@(Get|Post|Put|Delete|Patch)\(\s*['"]([^'"]+)['"]""", 1, 2),
        (r"""@Controller\(\s*['"]([^'"]+)['"]""", None, 1),
    ],
    "go": [
        (r"""\.(GET|POST|PUT|DELETE|PATCH|Handle|HandleFunc)\(\s*"([^"]+)\"""", 1, 2),
        (r"""HandleFunc\(\s*"([^"]+)\"""", None, 1),
    ],
}
CLIENT_ENDPOINTS = [
    (r"""(?:requests|httpx)\.(get|post|put|delete|patch)\(\s*['"]([^'"]+)['"]""", 1, 2),
    (r"""(?:fetch|axios)\.(get|post|put|delete|patch)?\(\s*['"`]([^'"`]+)['"`]""", 1, 2),
    (r"""fetch\(\s*['"`]([^'"`]+)['"`]""", None, 1),
]
ANY_METHOD = ["route", "all", "handle", "handlefunc"]
WORD_PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def word_split(name: Column) -> Column:
    """Lower-case words of a camelCase or snake_case name; a part without letters or digits stands for itself."""
    parts = F.filter(F.split(name, "_"), lambda p: p != "")

    def words(p: Column) -> Column:
        found = F.regexp_extract_all(p, F.lit(WORD_PARTS), F.lit(0))
        return F.when(F.size(found) > 0, F.transform(found, F.lower)).otherwise(F.array(F.lower(p)))

    return F.flatten(F.transform(parts, words))


def path_phrase(path: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^(src|lib|app|pkg|internal)/", ""), r"(?<=.)\.[^.]*$", "")
    return F.array_join(F.flatten(F.transform(F.split(plain, "/"), word_split)), " ")


def compact_signature(name: Column, signature: Column) -> Column:
    words = F.array_join(word_split(name), " ")
    short = F.regexp_replace(F.coalesce(signature, F.lit("")), "self, ?|self", "")
    return F.when((short != "") & (short != "()"), F.concat(words, short)).otherwise(words)


def first_sentence(doc: Column) -> Column:
    trimmed = F.trim(F.coalesce(doc, F.lit("")))
    return F.when(F.length(trimmed) > 15, F.nullif(F.trim(F.element_at(F.split(trimmed, r"\."), 1)), F.lit("")))


def scaffold(path: Column, kind: Column, name: Column, signature: Column, qualified: Column, doc: Column, callees: Column, types: Column) -> Column:
    """Text of a definition: module, signature, parent, calls (30 at most), types (20 at most), first sentence."""
    parent = F.when(F.contains(qualified, F.lit(".")), F.array_join(word_split(F.translate(F.regexp_replace(qualified, r"\.[^.]*$", ""), ".", "_")), " "))
    calls = F.slice(F.array_sort(F.array_distinct(F.filter(F.coalesce(callees, F.array().cast("array<string>")), lambda c: F.length(c) >= 2))), 1, 30)
    uses = F.slice(F.array_sort(F.array_except(F.coalesce(types, F.array().cast("array<string>")), calls)), 1, 20)
    return F.concat_ws(
        "\n", F.concat(F.lit("module "), F.nullif(path_phrase(path), F.lit(""))), F.concat(kind, F.lit(" "), compact_signature(name, signature)),
        F.concat(F.lit("in "), F.nullif(parent, F.lit(""))), F.when(F.size(calls) > 0, F.concat(F.lit("calls "), F.array_join(calls, ", "))),
        F.when(F.size(uses) > 0, F.concat(F.lit("uses "), F.array_join(uses, ", "))), F.concat(F.lit("describes "), first_sentence(doc)),
    )


def task_words(task: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(task), "[^a-z]+"), lambda w: w != ""))


def intent(task: Column) -> Column:
    """The kind of task with the most key words; on a tie the first kind; unknown without any."""
    words = task_words(task)
    hits = [F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in k]))) for k in INTENTS.values()]
    best = F.greatest(*hits)
    found = F.when(best == 0, "unknown")
    for name, n in zip(INTENTS, hits, strict=True):
        found = found.when(n == best, name)
    return found


def is_stacktrace(task: Column) -> Column:
    low = F.lower(task)
    hits = F.size(F.array_intersect(task_words(task), F.array(*[F.lit(w) for w in STACKTRACE])))
    return F.contains(low, F.lit("stack trace")) | F.contains(low, F.lit("traceback:")) | (hits >= 2)


def is_test_driven(task: Column) -> Column:
    """The task itself is about tests: by its intent, or a phrase that says so."""
    low = F.lower(task)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in TEST_DRIVEN]) | (intent(task) == "test"), F.lit(False))


def negative_mentions(task: Column) -> Column:
    terms = F.transform(F.regexp_extract_all(task, F.lit(NEGATIONS), F.lit(1)), lambda t: F.regexp_replace(F.lower(t), r"^[.,;:!?]+|[.,;:!?]+$", ""))
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) >= 2))


def task_terms(task: Column, least: int = 4) -> Column:
    """Distinct words of at least so many characters, longest first, then in order of the alphabet."""
    words = F.array_distinct(F.filter(F.split(F.lower(task), "[^a-z0-9_]+"), lambda w: F.length(w) >= least))
    keyed = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(keyed, lambda x: x["w"])


def quoted(task: Column) -> Column:
    return F.regexp_extract_all(task, F.lit("""['"]([^'"]+)['"]"""), F.lit(1))


def task_paths(task: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(task, F.lit(r"(?:\./)?((?:[\w-]+/)+[\w-]+\.\w+)"), F.lit(1)))


def task_symbols(task: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(task, F.lit(r"\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z]+(?:_[a-z0-9]+)+)\b"), F.lit(1)))


def def_uid(*parts: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def worktree_uid(uid: Column, worktree_id: Column, is_main: Column) -> Column:
    return F.when(is_main, uid).otherwise(def_uid(worktree_id.cast("string"), uid))


def return_type(signature: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(signature, r"\)\s*(?:->|:)\s*(.+)$", 1)), F.lit(""))


def parameters(signature: Column) -> Column:
    """Text between the outermost parentheses."""
    return F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)


def delta_tags(change: Column, old_signature: Column, new_signature: Column, lines_changed: Column) -> Column:
    """What a change is made of."""
    parts = F.array_compact(F.array(
        F.when(~parameters(old_signature).eqNullSafe(parameters(new_signature)), "parameters_changed"),
        F.when(~return_type(old_signature).eqNullSafe(return_type(new_signature)), "return_type_changed"),
    ))
    by_signature = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("signature_changed")))
    by_body = (
        F.when(lines_changed.isNull(), F.array(F.lit("body_logic_changed"))).when(lines_changed <= 2, F.array(F.lit("minor_change"), F.lit("possibly_comment_or_whitespace")))
        .when(lines_changed <= 3, F.array(F.lit("minor_change"))).when(lines_changed > 20, F.array(F.lit("major_change"))).otherwise(F.array(F.lit("body_logic_changed")))
    )
    return (
        F.when(change == "added", F.array(F.lit("symbol_added"))).when(change == "removed", F.array(F.lit("symbol_removed")))
        .when(change == "renamed", F.array(F.lit("symbol_renamed"))).when(change == "signature_changed", by_signature)
        .when(change == "body_changed", by_body).otherwise(F.array().cast("array<string>"))
    )


def behaviour_risk(change: Column, references: Column) -> Column:
    return (
        F.when(change == "added", "low").when(change.isin("removed", "renamed", "signature_changed"), "high")
        .when((change == "body_changed") & (references > 10), "medium").otherwise("unknown")
    )


def overlap(start: Column, end: Column, hunks: Column) -> Column:
    """Lines that an interval shares with hunks (array of structs start, end); null if none."""
    n = F.aggregate(hunks, F.lit(0).cast("long"), lambda a, h: a + F.greatest(F.lit(0), F.least(end, h["end"]) - F.greatest(start, h["start"]) + 1))
    return F.when(n > 0, n)


def _reference(i: Column, level: Column):
    return lambda t: F.struct((i + 1).cast("int").alias("line"), t.alias("target"), level.alias("confidence"))


def _with_new(targets: Column, i: Column, level: Column):
    return lambda found: F.concat(found, F.transform(F.array_except(targets, F.transform(found, lambda x: x["target"])), _reference(i, level)))


def cross_references(text: Column) -> Column:
    """array of structs (line, target, confidence): each target of a line once, with its best confidence."""
    none = F.array().cast("array<struct<line:int,target:string,confidence:string>>")

    def of_line(line: Column, i: Column) -> Column:
        found = none
        for pattern, confidence in CROSS_REFERENCES:
            targets = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda t: F.trim(t)), lambda t: F.length(t) >= 2))
            if confidence == "low":
                targets = F.when(F.trim(line).rlike("^(def|class|import|from) |^$"), F.array().cast("array<string>")).otherwise(targets)
            level = F.lit(confidence)  # bound below by its value: a lambda's further parameters would be taken for its own
            # what was found so far is named by an array of one: written out twice, each pattern would double the work of those before
            found = F.transform(F.array(found), _with_new(targets, i, level))[0]
        return found

    return F.flatten(F.transform(F.split(text, "\n"), of_line))


def _endpoint(i: Column, kind: str, method: Column, url: Column) -> Column:
    return F.struct((i + 1).cast("int").alias("line"), F.lit(kind).alias("kind"), method.alias("method"), url.alias("url"))


def _found(line: Column, i: Column, kind: str, pattern: str, method: int | None, url: int) -> Column:
    """The endpoints of a line by one pattern."""
    urls = F.regexp_extract_all(line, F.lit(pattern), F.lit(url))
    if method is None:
        return F.transform(urls, lambda u: _endpoint(i, kind, F.lit("*" if kind == "server" else "GET"), u))

    def named(m: Column) -> Column:
        return F.when(F.lower(m).isin(ANY_METHOD), "*").when(m == "", "GET").otherwise(F.upper(m))

    return F.zip_with(F.regexp_extract_all(line, F.lit(pattern), F.lit(method)), urls, lambda m, u: _endpoint(i, kind, named(m), u))


def endpoints(source: Column, language: Column) -> Column:
    """array of structs (line, kind, method, url): servers by the language's patterns, and clients' calls of paths and web addresses."""
    none = F.array().cast("array<struct<line:int,kind:string,method:string,url:string>>")

    def of_line(line: Column, i: Column) -> Column:
        servers = [F.when(language == name, F.concat(*[_found(line, i, "server", *p) for p in patterns])).otherwise(none) for name, patterns in SERVER_ENDPOINTS.items()]
        clients = F.concat(*[_found(line, i, "client", *p) for p in CLIENT_ENDPOINTS])
        return F.concat(*servers, F.filter(clients, lambda x: x["url"].rlike("^(/|https?://)")))

    return F.flatten(F.transform(F.split(source, "\n"), of_line))


def sparse_round(vector: Column) -> Column:
    """Weights of a map<int,double> at four decimals, without zeros."""
    return F.map_filter(F.transform_values(vector, lambda _, w: F.round(w, 4)), lambda _, w: w != 0)


def sparse_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(F.element_at(a, k) * F.element_at(b, k), F.lit(0.0)))
