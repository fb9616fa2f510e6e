"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siteloom import build_session  # noqa: E402
from siteloom.plans import registry  # noqa: E402

HEADLINE = [
    "audit_pages", "page_issues", "duplicate_titles", "page_features", "canonical_urls", "incoming_links", "audit_scores",
    "grouped_issues", "issue_diff", "audit_trend", "monitoring_alerts", "search_opportunities", "search_totals",
    "keyword_intents", "keyword_pairs", "cluster_profiles", "link_suggestions", "semantic_links", "robots_filter",
    "rate_windows", "usage_monthly", "usage_quota", "job_state", "recommendation_gate", "blocked_addresses",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    names = sys.argv[1:] or HEADLINE
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("page_issues", "keyword_intents"):
            registry.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
