"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

QUERIES = (
    "ident_metrics", "cmc", "prf_per_class", "ident_per_condition", "score_cosine", "score_l2", "score_chi2", "rank_matrix_topk", "weight_sweep", "auc", "eer", "tar_at_far", "roc_points_pairs", "score_moments",
    "score_hist", "pairs_genuine", "pairs_impostor", "split_p2", "manifest_validate", "curvature", "curv_hist", "histeq", "pca_project", "lbp", "seed_mean_std", "cloud_crop",
)


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from matchbench.plans.queries import QUERIES as known

    known["ident_metrics"](spark, sf_dir).collect()  # starts workers
    took = {}
    for name in QUERIES:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
