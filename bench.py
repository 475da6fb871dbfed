"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and
the cores. Each query is run to the end into a sink that discards its rows, after one run that
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

import distlearn as dl  # noqa: E402
from distlearn.operators.datasets import make_blobs, make_classification, make_gaussian, make_regression  # noqa: E402
from distlearn.queries import QUERIES  # noqa: E402

HEADLINE = [
    "standard_scaler", "minmax_scaler", "label_encoder_numbers", "pca", "truncated_svd", "pca_inverse", "linear_regression",
    "ridge", "lasso", "elasticnet", "logistic_regression", "chain_scaler_logistic", "sgd_regressor", "svc", "svr", "random_forest_classifier",
    "random_forest_regressor", "kneighbors", "kneighbors_pruned", "knn_classifier", "knn_regressor", "kmeans", "kmeans_lloyd", "dbscan",
    "dbscan_plane", "roc_auc", "classification_report", "kfold_scores", "tf_idf", "stream_score",
]


SHAPES = {
    "standard_scaler_5000x20": (lambda s: make_gaussian(5000, 20, spark=s), lambda: dl.StandardScaler()),
    "pca_5000x20": (lambda s: make_gaussian(5000, 20, spark=s), lambda: dl.PCA(n_components=5)),
    "linear_regression_5000x20": (lambda s: make_regression(5000, 20, noise=0, spark=s), lambda: dl.LinearRegression()),
    "logistic_regression_5000x20": (lambda s: make_classification(5000, 20, spark=s), lambda: dl.LogisticRegression()),
    "kmeans_5000x20": (lambda s: make_blobs(5000, 20, spark=s), lambda: dl.KMeans(n_clusters=3)),
    "random_forest_500x20": (lambda s: make_classification(500, 20, spark=s), lambda: dl.RandomForestClassifier(n_estimators=50)),
    "svc_500x20": (lambda s: make_classification(500, 20, spark=s), lambda: dl.SVC()),
    "standard_scaler_10000x1280": (lambda s: make_gaussian(10000, 1280, spark=s), lambda: dl.StandardScaler()),
    "standard_scaler_1000x20": (lambda s: make_gaussian(1000, 20, spark=s), lambda: dl.StandardScaler()),
    "standard_scaler_5000x480": (lambda s: make_gaussian(5000, 480, spark=s), lambda: dl.StandardScaler()),
}


def shape_times(spark: SparkSession) -> dict[str, float]:
    """Fit and use on rows that are in memory, second of two runs."""
    times = {}
    for name, (make, operator) in SHAPES.items():
        rows = make(spark).coalesce(4).persist()
        rows.count()
        for _ in range(2):
            start = time.perf_counter()
            operator().fit(rows).transform(rows).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        rows.unpersist()
    return times


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("distlearn-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))  # one machine
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing
    QUERIES["standard_scaler"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    shapes = {} if sys.argv[1:] else shape_times(spark)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "shapes": shapes, "sf": Path(folder).name.removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
