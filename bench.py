"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sitefit.catalog import load
from sitefit.session import local_session

HEADLINE = ("checks", "binding", "neighbour_checks", "nearest_by_type", "point_in_polygon", "legal_points", "area_budget",
            "heuristic_score", "greedy_select", "density_cap", "plan_items", "plan_diff", "edit_fold", "classify_layer")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries, _ = load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
