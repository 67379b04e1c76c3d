"""Headline timings: one JSON line.

The session is warmed on the smallest tables. Each timed query then starts without stored
stages, writes its whole result to the no-op sink, and reports wall-clock seconds. ``BENCH_RUNS`` > 1 takes
the median.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from catalog_audit.registry import QUERIES, fresh
from catalog_audit.session import release_stages

# the first entry lands the feeds and audits them, which the others read
HEADLINE = [
    "coverage_register", "retirement_case", "usage_rollup", "field_views", "failed_source_recent_views", "column_divergence", "normalize_formula",
    "token_bind", "formula_closure", "concept_groups", "rank_groups", "definition_multiplicity", "material_disagreement",
    "secret_scan", "load_lineage", "stream_usage_rollup", "evaluate_rules", "domain_register",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stages-")).config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in HEADLINE:  # one estate: stages are shared, only the plans are warmed
        QUERIES[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs):
            fresh()
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
            release_stages(spark)
        took[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
