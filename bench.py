"""Benchmark: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from termlens.plans import catalog  # noqa: E402
from termlens.session import get_spark  # noqa: E402

HEADLINE = [
    "top_terms_avg",
    "top_terms_homogeneity",
    "top_terms_exclusive",
    "risk_terms",
    "confusion",
    "prf_averages",
    "global_effects",
    "attr_ig",
    "removal_f1",
    "global_masks",
    "processed_attrs",
    "pool_avgmaxnorm",
    "sentences",
    "label_profile",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2)
    times = {}
    failed = []
    for name in names:
        t0 = time.time()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # noqa: BLE001 - report and keep timing the others
            failed.append(name)
            print(f"{name}: FAILED {type(exc).__name__}: {str(exc)[:300]}", file=sys.stderr, flush=True)
            continue
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "failed": failed,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
