"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from shalebed.plans.shapes import QUERIES

NAMES = [
    "path_profile", "props_kind_profile", "props_path_lookup", "truthy_counts", "conditional_constraint", "layered_merge", "precedence_lookup", "version_fallback", "infer_unique", "evidence_by_path", "render_site_antijoin", "subsumption", "intern_repeats",
    "string_transforms", "checksums", "numeric_cast", "lattice_merge", "guards_of_values", "requirements_of_values", "semver_constraints", "spans_of_points", "condition_rank", "template_rows",
]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["truthy_counts"](spark, d).collect()  # start-up and first reads are no query's time
    took = {}
    for n in NAMES:
        start = time.time()
        QUERIES[n](spark, d).write.format("noop").mode("overwrite").save()
        took[n] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
