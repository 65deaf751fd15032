"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "ngram_counts", "overlap_label", "token_scores", "top_next_token", "mink_features",
    "mink_flagship", "ngram_accuracy", "cdd_features", "ngram_cdd_features", "ngram_ll_features",
    "curve_features", "tune_mink", "tune_documents", "best_threshold_lineitem", "best_pair_2d",
    "stratified_split", "box_stats", "bootstrap_ci", "performance_gap", "few_shot_prompts",
    "char_edit_distance",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from leakscope.plans import registry
    from leakscope.session import local_session

    registry.load()
    spark = local_session(
        "leakscope-bench", cpus, **{"spark.ui.showConsoleProgress": "false"}
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name,
                "cores": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
