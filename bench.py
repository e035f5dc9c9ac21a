"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from seatwise.plans import registry

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "cascade_counts", "selection_table", "topk_exact", "topk_tie_info", "completion_rates", "subject_gaps", "marginals", "sample_vs_full", "stratified_split", "target_encode",
    "group_metrics", "average_precision", "frontier", "income_increment", "bootstrap_multinomial", "main_grid", "main_bootstrap", "population", "threshold_cells", "income_strata",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["cascade_counts"](spark, FOLDER).collect()  # warms the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": FOLDER.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
