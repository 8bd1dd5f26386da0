"""Queries of routing and of the explicit and sparse harvesters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harvest
from .registry import query


@query("o015_context_routing", """
    WITH c(context_id, root_path, tier) AS (VALUES (1, 'src/pkg1', 1), (2, 'src', 2), (3, 'src/pkg2', 1), (9, '', 3)),
         m AS (SELECT path, context_id, row_number() OVER (PARTITION BY path ORDER BY tier, length(root_path) DESC, context_id) AS p FROM files JOIN c ON root_path = '' OR starts_with(path, root_path || '/'))
    SELECT path, context_id FROM m WHERE p = 1""")
def _(f):
    contexts = f.spark.createDataFrame([(1, "src/pkg1", 1), (2, "src", 2), (3, "src/pkg2", 1), (9, "", 3)], "context_id int, root_path string, tier int")
    return harvest.route_files(f.files, contexts)


@query("o222_explicit_harvest", """
    WITH u AS (SELECT def_uid, 0 AS p FROM defs WHERE def_uid IN ('d3', 'd8') UNION ALL SELECT def_uid, 2 FROM defs WHERE file_id IN (3, 4) UNION ALL SELECT def_uid, 3 FROM defs WHERE name = 'red_widget')
    SELECT def_uid, CASE min(p) WHEN 0 THEN 'agent_seed' WHEN 2 THEN 'path_mention' ELSE 'task_extracted' END AS source FROM u GROUP BY 1""")
def _(f):
    seeds = f.spark.createDataFrame([("d3",), ("d8",)], "def_uid string")
    symbols = f.spark.createDataFrame([("red_widget",)], "name string")
    return harvest.explicit(seeds, f.files.where("id IN (3, 4)"), symbols, f.defs, f.files)


@query("o221_scaffold_fetch", "SELECT def_uid, CASE WHEN file_id % 2 = 0 THEN 'stored ' || name ELSE kind || ' ' || name END AS scaffold FROM defs")
def _(f):
    stored = f.defs.where("file_id % 2 = 0").select("def_uid", F.concat(F.lit("stored "), "name").alias("scaffold"))
    return harvest.with_scaffolds(f.defs, stored).select("def_uid", "scaffold")


@query("o218_sparse_harvest", """
    WITH q AS (SELECT 'ring' AS term, 1.5 AS w UNION ALL SELECT 'red', 1.0), t AS (SELECT def_uid, unnest(string_split(name, '_')) AS term FROM defs)
    SELECT def_uid, round(sum(w), 6) AS splade_score FROM t JOIN q USING (term) GROUP BY 1 HAVING sum(w) >= 1.0""")
def _(f):
    from ..operators import sparse

    q = f.spark.createDataFrame([("q", "ring", 1.5), ("q", "red", 1.0)], "query_id string, term string, weight double")
    v = f.defs.select("def_uid", F.explode(F.split("name", "_")).alias("term"), F.lit(1.0).alias("weight"))
    return sparse.retrieve(q, v, "query_id", "def_uid", 1.0, 1 << 30).select("def_uid", F.col("score").alias("splade_score"))


@query("o142_file_features_serve", """
    WITH c AS (SELECT f.path, CAST(end_line - start_line AS DOUBLE) AS score, kind = 'class' AS t FROM defs d JOIN files f ON f.id = d.file_id)
    SELECT path, count(*) AS defs, max(score) AS max_score, round(sum(score), 4) AS sum_score, round(avg(score), 6) AS mean_score, CAST(0 AS BIGINT) AS max_hub, false AS any_test, CAST(count(*) FILTER (t) AS BIGINT) AS term_hits FROM c GROUP BY 1""")
def _(f):
    from ..operators import aggregates

    c = f.defs.join(f.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    c = c.select("path", (F.col("end_line") - F.col("start_line")).cast("double").alias("score"), F.lit(0).cast("long").alias("hub_score"), F.lit(False).alias("is_test"), (F.col("kind") == "class").alias("from_term"))
    return aggregates.file_features(c, ["path"])
