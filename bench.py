"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from concord.plans import catalog

NAMES = ["align_orders", "json_profile", "cast_number", "validate_issues", "shape_cluster", "hash_embed_cosine", "hybrid_rrf", "vector_topk", "chunk_docs", "dedupe_sha256", "resolve_units", "nearest_caption", "anti_overlap", "converge_rounds", "library_latest", "wide_mapping", "batch_pathways", "table_cells", "value_extraction", "inspect_images", "vocabulary_merge", "align_stream"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
