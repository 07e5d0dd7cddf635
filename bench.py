"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import time
from statistics import median

from lodegrid.catalog import load_all
from lodegrid.catalog.registry import QUERIES
from lodegrid.session import build_session

HEADLINE = [
    "scores_last_write_wins", "scores_fused", "cells_ranked", "rank_correlation", "raster_modal_label", "wofe_native_scores",
    "wofe_rollup", "aoi_cover", "polygon_cell_overlay", "cell_occurrence_facts", "interpolated_fine_grid", "pin_nearest_occurrence",
    "cell_toponyms", "cache_composite", "working_percentiles", "feature_upsert", "document_triage", "usage_by_agent",
]

WARM_UP = "usage_by_agent"
#: A query is timed up to three times, and again only while it has taken less than this in all; the median is reported.
AGAIN_SECONDS = 8


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session(cpus, "bench", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(WARM_UP)  # the start of the JVM and of the session is nobody's time
    times = {}
    for name in HEADLINE:
        runs = [seconds(name)]
        while len(runs) < 3 and sum(runs) < AGAIN_SECONDS:
            runs.append(seconds(name))
        times[name] = round(median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
