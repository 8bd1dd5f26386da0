"""Source facts over the driver's tables.

The driver's tables hold no code, so each fact table of the engine is a view of
them with the fact table's columns: customers stand for files, parts for
definitions, order lines for references and coverage, orders for imports and
lint results, events for versioned snapshots. The definitions are plain SQL
that Spark and DuckDB read alike; operators only see the resulting DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

PATH = (
    "CASE WHEN {k} % 7 = 0 THEN 'tests/' ELSE 'src/' END || 'pkg' || CAST({k} % 20 AS STRING) || '/' || "
    "CASE WHEN {k} % 7 = 0 THEN 'test_m' ELSE 'm' END || CAST({k} AS STRING) || "
    "CASE {k} % 5 WHEN 1 THEN '.go' WHEN 2 THEN '.java' WHEN 3 THEN '.md' ELSE '.py' END"
)
MODULE = "'pkg' || CAST({k} % 20 AS STRING) || '.m' || CAST({k} AS STRING)"

FACTS: dict[str, str] = {
    "fact_count": "SELECT CAST(count(*) AS BIGINT) AS nf FROM customer",
    "files": f"""
        SELECT c_custkey AS id, CAST(1 + c_custkey % 3 AS BIGINT) AS worktree_id, {PATH.format(k='c_custkey')} AS path,
               CASE c_custkey % 5 WHEN 1 THEN 'go' WHEN 2 THEN 'java' WHEN 3 THEN 'markdown' ELSE 'python' END AS language_family,
               md5(c_mktsegment || CAST(c_custkey % 97 AS STRING)) AS content_hash, CAST(50 + c_custkey % 400 AS BIGINT) AS line_count,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey AS DOUBLE) END AS indexed_at,
               {MODULE.format(k='c_custkey')} AS declared_module
        FROM customer""",
    "defs": """
        SELECT 'd' || CAST(p_partkey AS STRING) AS def_uid, p_partkey % nf AS file_id, CAST(1 + p_partkey % 4 AS BIGINT) AS unit_id,
               CASE p_size % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'variable' WHEN 3 THEN 'interface' ELSE 'function' END AS kind,
               replace(p_name, ' ', '_') AS name, 'pkg' || CAST(p_partkey % 20 AS STRING) || '.' || replace(p_name, ' ', '.') AS qualified_name,
               CASE WHEN p_size % 6 = 1 THEN 'C' || CAST(p_size AS STRING) || '.' ELSE '' END || replace(p_name, ' ', '_') AS lexical_path,
               'pkg' || CAST(p_partkey % 20 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.sub' ELSE '' END AS namespace,
               CAST(1 + (p_partkey * 37) % 300 AS BIGINT) AS start_line, CAST(1 + (p_partkey * 37) % 300 + p_size AS BIGINT) AS end_line,
               md5(p_type) AS signature_hash, '(self, ' || lower(p_brand) || ') -> ' || p_type AS signature_text,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Makes ' || p_name || '. See ' || p_brand END AS docstring
        FROM part, fact_count""",
    "refs": """
        SELECT l_orderkey * 10 + l_linenumber AS ref_id, l_orderkey % nf AS file_id, CAST(1 + l_orderkey % 4 AS BIGINT) AS unit_id,
               CAST(1 + (l_orderkey * 7 + l_linenumber * 31) % 350 AS BIGINT) AS start_line,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE 'd' || CAST(l_partkey AS STRING) END AS target_def_uid,
               CASE WHEN l_returnflag = 'A' THEN 'proven' WHEN l_returnflag = 'R' THEN 'strong' WHEN l_linenumber % 2 = 0 THEN 'anchored' ELSE 'unknown' END AS ref_tier,
               CASE WHEN l_linestatus = 'F' THEN 'certain' ELSE 'uncertain' END AS certainty,
               'tok' || CAST(l_suppkey % 50 AS STRING) AS token_text, CAST(l_suppkey % 40 AS BIGINT) AS scope_id
        FROM lineitem, fact_count""",
    "imports": f"""
        SELECT 'i' || CAST(o_orderkey AS STRING) AS import_uid, o_custkey % nf AS file_id, CAST(1 + o_custkey % 4 AS BIGINT) AS unit_id,
               'name' || CAST(o_orderkey % 30 AS STRING) AS imported_name, CASE WHEN o_orderkey % 9 = 0 THEN 'wildcard' ELSE 'python_from' END AS import_kind,
               CASE WHEN o_orderkey % 6 = 0 THEN 'al' || CAST(o_orderkey % 30 AS STRING) END AS alias,
               {MODULE.format(k='((o_orderkey * 13 + o_custkey) % nf)')} AS source_literal,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {PATH.format(k='((o_orderkey * 13 + o_custkey) % nf)')} END AS resolved_path,
               CAST(1 + o_orderkey % 60 AS BIGINT) AS start_line
        FROM orders, fact_count""",
    "coverage": """
        SELECT 'tests/pkg' || CAST(l_suppkey % 20 AS STRING) || '/test_m' || CAST(l_suppkey * 7 AS STRING) || '.py::case' || CAST(l_linenumber AS STRING) AS test_id,
               'd' || CAST(l_partkey AS STRING) AS target_def_uid, CAST(l_quantity AS BIGINT) AS covered_lines, CAST(50 AS BIGINT) AS total_lines,
               l_quantity / 50.0 AS line_rate, CAST(l_orderkey % 5 AS BIGINT) AS epoch, l_returnflag = 'R' AS stale
        FROM lineitem WHERE l_linestatus = 'F'""",
    "lint": f"""
        SELECT {PATH.format(k='(o_custkey % nf)')} AS file_path, o_orderpriority AS tool_id, CAST(o_orderkey % 4 AS BIGINT) AS error_count,
               CAST(o_orderkey % 7 AS BIGINT) AS warning_count, CAST(o_orderkey % 2 AS BIGINT) AS info_count,
               o_orderkey % 4 = 0 AND o_orderkey % 7 = 0 AS clean, CAST(o_orderkey % 3 AS BIGINT) AS epoch
        FROM orders, fact_count""",
    "impls": """
        SELECT 'd' || CAST(p_partkey AS STRING) AS implementor_def_uid, 'I' || CAST(p_size AS STRING) || lower(p_brand) AS interface_name FROM part
        UNION ALL SELECT 'd' || CAST(p_partkey AS STRING), 'J' || CAST(p_partkey % 101 AS STRING) FROM part""",
    "scopes": """
        SELECT p_partkey AS scope_id, p_partkey % nf AS file_id, CASE WHEN p_size % 3 = 0 THEN 'class' WHEN p_size % 3 = 1 THEN 'function' ELSE 'block' END AS kind,
               CAST(1 + (p_partkey * 37) % 300 AS BIGINT) AS start_line, CAST(1 + (p_partkey * 37) % 300 + p_size * 3 AS BIGINT) AS end_line
        FROM part, fact_count
        UNION ALL SELECT 10000000 + c_custkey, c_custkey, 'file', CAST(1 AS BIGINT), CAST(100000 AS BIGINT) FROM customer""",
    "xrefs": """
        SELECT 'd' || CAST(l_partkey AS STRING) AS source_def_uid, 'd' || CAST((l_partkey * 3 + l_suppkey) % 200 AS STRING) AS target_def_uid,
               CASE WHEN l_linenumber = 1 THEN 'high' ELSE 'low' END AS confidence, l_orderkey * 10 + l_linenumber AS id
        FROM lineitem WHERE l_linenumber <= 2""",
    "endpoints": """
        SELECT page_id AS id, 'd' || CAST(page_id % 100 AS STRING) AS handler_def_uid, CASE WHEN page_id % 3 = 0 THEN 'server' ELSE 'client' END AS kind,
               CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS http_method,
               '/' || split_part(split_part(url, '?', 1), '/', 4) || '/' || split_part(split_part(url, '?', 1), '/', 5) AS url_pattern
        FROM pages""",
    "snapshots": """
        SELECT CAST(event_id % 12 AS BIGINT) AS epoch_id, 'f' || CAST(user_id % 40 AS STRING) AS file_path, event_type || '.' || CAST(user_id AS STRING) AS lexical_path,
               CASE WHEN event_type = 'click' THEN 'function' ELSE 'class' END AS kind, md5(CAST(CAST(floor(value) AS BIGINT) % 9 AS STRING)) AS signature_hash,
               CAST(event_id % 200 AS BIGINT) AS start_line, CAST(event_id % 200 + 5 AS BIGINT) AS end_line, event_id AS record_id
        FROM events""",
}
NEEDS = {k: [x for x in FACTS if x != k and re.search(rf"\b{x}\b", re.sub(r"'[^']*'", "", v).split("FROM", 1)[-1])] for k, v in FACTS.items()}


def needed(text: str) -> list[str]:
    """The fact tables that text names, with those they need, in order."""
    plain = re.sub(r"'[^']*'", "", text)
    found = {k for k in FACTS if re.search(rf"\b{k}\b", plain)}
    found |= {x for k in found for x in NEEDS[k]}
    return [k for k in FACTS if k in found]


def oracle(text: str) -> str:
    """DuckDB SQL that may name fact tables."""
    ctes = [f"{k} AS ({FACTS[k]})" for k in needed(text)]
    if not ctes:
        return text
    body = text.strip()
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE") :]
    if re.match(r"WITH\b", body, re.I):
        return "WITH " + ", ".join(ctes) + ", " + body[len("WITH") :]
    return "WITH " + ", ".join(ctes) + " " + body


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fact table as a DataFrame."""
    text = f"WITH {', '.join(f'{k} AS ({FACTS[k]})' for k in needed(name) if k != name)} {FACTS[name]}" if needed(name)[:-1] else FACTS[name]
    for t in TABLES:
        text = re.sub(rf"\bFROM {t}\b", f"FROM parquet.`{sf_dir}/{t}.parquet` AS {t}", text)
    return spark.sql(text)


def spread(df: DataFrame) -> DataFrame:
    """A table of texts over all cores, if its scan has fewer splits than there are cores; larger ones aren't shuffled.

    A small table's only row group is one task's, however many splits there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


class Facts:
    """The fact tables and the driver's tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in FACTS:
            return fact(self.spark, self.sf_dir, name)
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(table) if name == "documents" else table
        raise AttributeError(name)
