"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sightline.registry import QUERIES  # noqa: E402
from sightline.session import local_session  # noqa: E402

HEADLINES = [
    "hotspots", "density_summary", "marker_cells", "species_stats", "species_diameter", "avg_pair_distance", "leader_clusters",
    "distance_from_first", "near_row_pairs", "time_patterns", "timeline_weekly", "invasive_daily", "risk_alerts", "code_session_join",
    "build_manifest_taxa", "photos_per_species", "file_counter", "training_table", "dataset_audit", "clean_text", "page_records",
    "species_records", "assemble_pages", "advisory", "species_fallback", "knn", "knn_topk", "stream_live_counts",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the engine
    times = {}
    for name in names or HEADLINES:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(sys.argv[1:])
