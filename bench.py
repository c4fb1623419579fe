"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = ["summary_lineitem", "hist_fd", "boxplot_by_flag", "standard_scale", "f_classif", "roc_auc", "gaussian_nb", "ols_2d", "tfidf_l2", "knn_classify", "kmeans_one_lloyd", "stack_by_month"]


def main() -> None:
    from tessel.plans import catalogue
    from tessel.runtime import local_session

    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        began = time.time()
        catalogue.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF)}))


if __name__ == "__main__":
    main()
