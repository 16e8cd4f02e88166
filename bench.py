"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldproof.plans import catalog  # noqa: E402
from fieldproof.session import build_session  # noqa: E402

HEADLINE = [
    "segment_verdicts", "evidence_dedup", "position_gaps", "top_failure_reasons", "compliance_gate",
    "deficiency_report", "run_summary", "kpi_strip", "zone_digest", "failure_buckets",
    "effective_quality", "inherited_locations", "pending_photos", "first_occurrences", "within_budget",
    "overlay_coordinates", "coordinate_sources", "zone_assignment", "line_zones", "snapped_photos",
    "similar_fingerprints", "photo_clusters", "stage_runs", "merged_scores", "error_rates",
    "incremental_verdicts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog.entries()
    chosen = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in chosen:
        begin = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
