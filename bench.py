"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sparkloom import registry

ROOT = os.path.dirname(os.path.abspath(__file__))
# the Python workers import the package as well
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "split_manifest", "word_window_chunks", "page_limit_chunks", "chunk_coverage", "target_plan", "curation_reasons", "training_records", "type_distribution", "job_latest_state", "breaker_failure_rate",
    "document_sections", "section_tree", "math_marks", "semantic_chunks", "lexical_neighbors", "generation_prompts", "generated_examples", "report_lines", "document_chunks", "page_batches",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    registry.QUERIES["doc_token_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's work
    for name in HEADLINE:
        query = registry.QUERIES[name]
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
