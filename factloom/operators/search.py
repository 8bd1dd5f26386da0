"""Lexical retrieval: substring and boolean line search, snippets, BM25, match quality, overlays."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25's constants.
K1, B = 1.2, 0.75
TERM = r"[^\p{L}\p{N}]+"
FIELDS = ("path", "symbols", "context_id")


@dataclass
class Parsed:
    """OR groups of phrases and terms that must all be there, and terms that must not, for the whole query."""

    groups: list[list[str]] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    fields: list[tuple[str, str]] = field(default_factory=list)


def parse(query: str, literal: bool = False) -> Parsed:
    """Words are joined by AND; OR begins a new group; NOT bars the next; quotes hold phrases; field:value is kept apart."""
    if literal:
        return Parsed([query.lower().split()] if query.split() else [])
    out, group, barred = Parsed(), [], False
    for token in re.findall(r'"[^"]+"|\S+', query.lower()):
        word = token.upper()
        if word == "OR":
            out.groups, group, barred = out.groups + [group] * bool(group), [], False
        elif word == "NOT":
            barred = True
        elif word != "AND":
            name, colon, value = token.partition(":")
            phrase = len(token) > 2 and token[0] == token[-1] == '"'
            if not phrase and colon and name in FIELDS:
                out.fields.append((name, value))
            else:
                text = token[1:-1] if phrase else value if colon and name == "content" and value else token
                (out.negative if barred else group).append(text)
            barred = False
    out.groups += [group] * bool(group)
    return out


def predicate(parsed: Parsed, text: Column) -> Column:
    low = F.lower(text)
    any_of = [reduce(lambda a, b: a & b, [F.contains(low, F.lit(t)) for t in g]) for g in parsed.groups]
    found = reduce(lambda a, b: a | b, any_of) if any_of else F.lit(False)
    return reduce(lambda a, b: a & b, [found, *[~F.contains(low, F.lit(t)) for t in parsed.negative]])


def line_search(docs: DataFrame, key: str, query: str, context: int = 0, literal: bool = False, text: str = "text") -> DataFrame:
    """key, line, snippet of every line that matches; the document must match in the whole first, which spares splitting others."""
    parsed = parse(query, literal)
    all_of = [reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(t)) for t in g]) for g in parsed.groups]
    candidates = docs.where(reduce(lambda a, b: a | b, all_of)) if all_of else docs.where(F.lit(False))
    lines = F.split(text, "\n")
    found = candidates.select(key, lines.alias("_lines"), F.posexplode(lines).alias("_i", "_line")).where(predicate(parsed, F.col("_line")))
    begin = F.greatest(F.col("_i") - context, F.lit(0))
    end = F.least(F.col("_i") + context, F.size("_lines") - 1)
    return found.select(key, (F.col("_i") + 1).cast("long").alias("line"), F.array_join(F.slice("_lines", begin + 1, end - begin + 1), "\n").alias("snippet"))


def substring_search(df: DataFrame, term: str, columns: list[str], order: str, limit: int = 200) -> DataFrame:
    """Rows with the term, of two characters at least, in any of the columns, without regard to case."""
    if len(term) < 2:
        return df.limit(0)
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns])
    return df.where(hit).orderBy(order).limit(limit)


def match_score(name: Column, query: str) -> Column:
    """1 for equal, 0.8 for a beginning, 0.6 for a part; null for none."""
    low, q = F.lower(name), query.lower()
    return F.when(low == q, 1.0).when(low.startswith(q), 0.8).when(F.contains(low, F.lit(q)), 0.6)


def symbol_search(defs: DataFrame, query: str, order: list[str], limit: int, fallback: DataFrame | None = None) -> DataFrame:
    """Definitions by match quality; rows of the fallback that are not among them score just below the worst."""
    found = defs.withColumn("score", match_score(F.col("name"), query)).where(F.col("score").isNotNull())
    if fallback is not None:
        low = found.agg(F.coalesce(F.min("score"), F.lit(0.6)).alias("_low"))
        more = fallback.join(found.select("def_uid"), "def_uid", "left_anti").crossJoin(F.broadcast(low))  # one row
        found = found.unionByName(more.withColumn("score", F.col("_low") - 0.01).drop("_low"))
    return found.orderBy(F.col("score").desc(), *order).limit(limit)


def exploded(df: DataFrame, columns: list, array: Column, name: str) -> DataFrame:
    """One row for each element of a costly array.

    The outer form: for the inner one the optimiser adds a filter by the array's
    size, pushes it down to the scan, and so makes the array twice.
    """
    return df.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda t: t != "")


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """term, key, tf, dl: the inverted index, one row for each term of a document."""
    words = docs.select(key, tokens(F.col(text)).alias("_t"))
    terms = exploded(words, [key, F.size("_t").cast("long").alias("dl")], F.col("_t"), "term")
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, query_key: str, text: str = "text", query_text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """query_key, key, score for every document that shares a term with a query.

    Only the queries' terms are looked for, and a document's are counted before
    anything is shuffled. The planner broadcasts the queries' terms if they are
    few. Texts are split once: a term's documents are counted from the same
    exchange that the scores read.
    """
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    vocabulary = asked.select("term").distinct()
    words = docs.select(key, tokens(F.col(text)).alias("_t"))
    # the same count of letters' and digits' runs, without making them
    totals = docs.agg(F.count("*").alias("_n"), F.avg(F.coalesce(F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}]+")), F.lit(0))).alias("_avg"))
    terms = exploded(words, [key, F.size("_t").cast("long").alias("dl")], F.col("_t"), "term").join(vocabulary, "term", "left_semi")
    found = terms.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    # needs tf and dl, so that both readers of found have one plan and share its exchange
    df = found.groupBy("term").agg(F.sum(F.when((F.col("tf") > 0) & (F.col("dl") > 0), 1)).alias("df"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("_avg")))
    scored = found.join(df, "term").crossJoin(F.broadcast(totals)).select(key, "term", weight.alias("_w"))  # one row of totals
    return scored.join(asked, "term").groupBy(query_key, key).agg(F.sum("_w").alias("score"))


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), tie))
    return df.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def overlay(hits: DataFrame, path: str = "path", priority: str = "priority", score: str = "score") -> DataFrame:
    """One hit a path: of the worktree with the least priority number, the best score."""
    best = F.min_by(F.struct(*[c for c in hits.columns if c != path]), F.struct(F.col(priority), -F.col(score)))
    return hits.groupBy(path).agg(best.alias("_b")).select(path, "_b.*")


def term_harvest(defs: DataFrame, terms: DataFrame, columns: list[str], cap: int = 200) -> DataFrame:
    """def_uid, term_match_count, best_total: definitions with any of the stated terms, each term's first cap by def_uid."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.col("term")) for c in columns])
    found = defs.join(F.broadcast(terms), hit).select("def_uid", "term")  # a stated, short list of terms
    place = F.row_number().over(Window.partitionBy("term").orderBy("def_uid"))
    totals = found.groupBy("term").agg(F.count("*").alias("_total"))
    kept = found.withColumn("_p", place).where(F.col("_p") <= cap).join(F.broadcast(totals), "term")
    return kept.groupBy("def_uid").agg(F.count("*").alias("term_match_count"), F.max("_total").alias("best_total"))
