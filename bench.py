"""Time the headline queries; one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from plumbline.plans import catalog

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINES = ("batch_cramers_v", "duplicate_lineitem_features", "fold_stratified", "fold_group_greedy", "anova_f_in_fold", "topk_in_fold", "batch_center_in_fold", "auc_per_fold", "regression_f", "cv_logreg_ladder")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINES:
        began = time.time()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
