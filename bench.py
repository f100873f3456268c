"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewell.plans.catalog import QUERIES  # noqa: E402
from tracewell.session import local_session  # noqa: E402

HEADLINE = [
    "op_flatten_event", "op_dedup_id", "join_session_span", "win_features_all", "win_time_counts",
    "win_token_seq", "op_derive_flow", "split_time_fraction", "join_leak_anti", "agg_rule_matrix",
    "actor_ranking", "op_roc_auc", "op_threshold_sweep", "op_group_metrics", "inc_severity",
    "mon_increase", "str_actor_history", "str_incident_session", "ml_gbt_train", "ml_weight_sweep",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))

    def run(name: str, folder: str = sf) -> None:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    # Load the JVM's code paths on the smallest tables before timing.
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in ("op_flatten_event", "win_features_all", "op_roc_auc"):
        run(name, small if os.path.isdir(small) else sf)
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total seconds",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
