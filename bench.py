"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

Every query runs over its whole tables and is drained by a no-op sink, so all
output columns are computed. One small query first starts the JVM and Python.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from particlelake.plans.catalog import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "image_features",
    "filtered_image_features",
    "orientation_metrics",
    "particle_filter_and_shape",
    "grid_decision",
    "spatiotemporal_filter",
    "nearest_station",
    "nearest_station_by_cell",
    "join_places",
    "resolve_labels",
    "keep_ids",
    "merge_collections_last",
    "upsert",
    "period_average",
    "place_features",
    "numeric_summary",
    "contingency",
    "average_rank",
    "review_sample",
    "taxonomy_rank",
    "taxonomy_consistency",
    "preprocess_scale",
    "kruskal_wallis",
    "categorical_association",
    "cluster_profiles",
    "internal_metrics",
    "silhouette_exact",
    "silhouette_squared",
    "score_candidates",
    "pca_scores",
    "kmeans",
    "density_clusters",
    "ingest_records_stream",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("particlelake-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["cluster_counts"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
