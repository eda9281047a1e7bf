"""Time the headline queries once each, after one warm-up, and print one JSON line."""

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from quillspark.plans.queries import QUERIES
from quillspark.session import session

HEADLINE = [
    "weighted_pairs",
    "member_strength",
    "graph_density_clustering",
    "connected_components",
    "fractional_count_nation",
    "collaboration_by_year",
    "topic_year_journal",
    "dense_series_share",
    "trend_by_type",
    "cross_filter_excluding_self",
    "point_in_polygon",
    "flow_matrix",
    "citation_split",
    "canon",
    "kappa_pabak",
    "jury_vote",
    "language_hits",
    "boilerplate_docs",
    "exact_duplicates",
    "evidence_literal",
    "ctfidf_top_terms",
    "knn_cosine",
    "representatives",
    "reassign_noise",
    "stratified_allocation",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
