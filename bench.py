"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores
(default 8). BENCH_QUERIES: comma-separated names instead of the headline list, or ``all``.
Each query is run once; all rows of its result are computed (no-op sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from verseflux.queries import QUERIES  # noqa: E402

HEADLINE = [
    "parse_collection",
    "tokens_clean",
    "vocabulary",
    "bag_of_words",
    "lemmatize",
    "sentiment_lexicon",
    "sentiment_trained",
    "sentiment_bayes",
    "document_topics",
    "document_analysis",
    "file_lookup",
    "join_canonical",
    "correlate_features",
    "correlate_lineitem",
    "correlate_joined",
    "correlation_report",
    "compare_groups",
    "correlation_matrix",
    "regression_band",
    "bootstrap_band",
    "describe_features",
    "signal_rms",
    "signal_features",
    "signal_features_arrays",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("verseflux-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
