"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from netlens.session import local_session

HEADLINE = [
    "flagship_top_entities", "D01_dedup_mirror", "D07_attribute", "F05_unique_dst_ip_ratio_30s", "F22_http_method_entropy_60s", "F33_counts", "F35_l2_only_rows", "F37_live_horizon_rows",
    "R03_dns_view", "R05_http_view", "R12_all_rules", "N03_scan_triggers", "A08_apply_actions", "A17_coverage", "B05_audit", "B09_duplicate_vectors",
    "L02_sanitize", "L05_psi", "M04_score_iforest", "M08_lower_tail", "X18_ranking_metrics", "E06_seven_configs", "E16_token_envelope", "Q02_measure_drops", "S03_decode_packets",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "netlens-bench")
    from netlens.plans import catalog

    catalog.QUERIES["F33_counts"](spark, sf_dir).limit(1).count()  # warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_time", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
