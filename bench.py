"""Headline queries on one machine; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tableproof import registry  # noqa: E402
from tableproof.session import local_session  # noqa: E402

HEADLINE = [
    "e2_fingerprint_tree",
    "e3_fingerprint_sum",
    "e3_fingerprint_sum_values",
    "d1_compare_tables",
    "d1_compare_tables_values",
    "e5_content_fingerprint",
    "f1_retention_victims_both",
    "f2_missing_ranges",
    "d5_audit_site",
    "d7_reachable_base_binlog",
    "d16_skip_applied",
    "f5_latest_state",
    "i3_replay_to_mark",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    registry.load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best = taken if best is None else min(best, taken)
        times[name] = round(best, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, best of three, summed",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
                "lineitem_rows": lineitem,
                "lineitem_rows_per_sec": {k: int(lineitem / times[k]) for k in times if k.startswith(("e2_", "e3_"))},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
