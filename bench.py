"""Headline queries at one scale; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wagerframe.plans import catalogue  # noqa: E402
from wagerframe.session import local_session  # noqa: E402

HEADLINE = [
    "expected_value",
    "best_sets",
    "situation_rollup",
    "dominance_flags",
    "policy_metrics_by_field",
    "latest_answer_per_run",
    "progress_by_field",
    "pair_metrics_by_subset",
    "keep_first_document",
    "alternate_subsets",
    "ties_metrics",
    "mcq_accuracy",
    "seed_summary",
    "mean_difference_vectors",
    "spread_situations",
    "seeded_shuffle",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    seconds: dict[str, float] = {}
    for name in wanted:
        build = catalogue.queries()[name]
        build(spark, folder.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()  # warm-up
        start = time.time()
        build(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
