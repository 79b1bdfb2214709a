"""Headline queries over $BENCH_SF_DIR; prints one JSON line.

Every query is run in full into a sink that discards rows. The first run of each
warms up; the value is the median of the three runs after it. For the text
comparison the pairs of replies per second are given, too. The comparison of long
replies (`format_consistency`) is left out: its 750,000 pairs of distinct texts at
sf0.1 take minutes, as their number is that of the definition.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from checks.bindings import RUN_LOG, bind
from checks.queries import QUERIES
from replylens.operators.pairwise import pair_counts

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "price_resolution",
    "cost_by_model",
    "run_stats",
    "eval_basic",
    "evaluate_metrics",
    "evaluate_all",
    "recommendations",
    "structure_consistency",
    "format_consistency_log",
    "json_valid",
    "all_responses",
    "top3_responses",
    "model_summary",
    "clean_reviews",
    "search_reviews",
    "paginate",
    "limit_reviews",
    "approx_tokens",
    "render_prompts",
    "score_stub",
    "read_csv",
    "read_text_split",
)


def run(spark: SparkSession, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, name)
        seconds[name] = round(median(run(spark, name) for _ in range(3)), 3)
    n = pair_counts(bind(spark, SF_DIR, RUN_LOG)).agg({"pairs": "sum"}).first()[0]
    pairs = {"format_consistency_log": round(n / seconds["format_consistency_log"])}
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "pairs_per_sec": pairs, "sf": sf}))


if __name__ == "__main__":
    main()
