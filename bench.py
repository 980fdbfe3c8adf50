"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores of the local master.
Other queries run when named as arguments; ``all`` runs every registered one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from agentmetrics.catalog import QUERIES
from agentmetrics.session import build_session


HEADLINE = [
    "q_spend_rollup", "q_headline", "q_topk_rest", "q_mix_share", "q_usage_price", "q_savings",
    "q_a_sessions", "q_a_units", "q_b_units", "q_c_sessions", "q_segments_full", "q_rules",
    "q_fork_families", "q_asof_snapshot", "q_survival", "q_rework_commits", "q_reverts",
    "q_attribution", "q_window_semi", "q_fix_subjects", "q_accept_gate", "q_tier_grid", "q_flaky",
    "q_agreement", "q_upsert_outcome", "q_trace_edges"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/nation.parquet").groupBy("n_regionkey").count().collect()
    took, failed = {}, {}
    names = sys.argv[1:] or HEADLINE
    for name in QUERIES if names == ["all"] else names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
        except Exception as exc:  # a failing query must not hide the others
            failed[name] = str(exc).splitlines()[0][:200]
    out = {"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
           "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
