"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = [
    "o215_bm25_top20", "o216_sparse_retrieval", "o219_chunk_links", "o224_dense_top_k", "o047_line_search", "o120_hub_score", "o065_containment_edges", "o080_blast_radius",
    "o112_graph_harvest", "o152_rank_fusion", "o155_elbow", "o173_structural_diff", "o085_coverage_ingestion", "o144_gate_features", "o208_file_page_rank", "o200_markdown_chunks",
]


def main() -> None:
    from pyspark.sql import SparkSession

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from factloom.plans import catalogue

    known, took = catalogue.queries(), {}
    known["o001_point_lookup"](spark, sf_dir).collect()  # starts the session's machinery
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
