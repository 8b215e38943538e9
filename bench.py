"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from scriptorium.plans.registry import QUERIES
from scriptorium.session import local_session

HEADLINES = (
    "scan_catalog", "encoding_structural", "classify_report_row", "top_extensions", "to_utf8", "sjis_runs",
    "sentence_segments", "code_segments", "code_tokens", "detected_items", "cache_lookup", "notes_per_line",
    "inject_translations", "modernize_plan", "latest_annotation", "annotation_history", "parse_annotation_blob",
    "apply_line_edits", "merge_tool_notes", "resolve_path", "path_tree", "dir_listing",
)
RUNS = 3


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in names:
        timed(QUERIES[name], spark, folder)  # warm-up
        seconds[name] = round(statistics.median(timed(QUERIES[name], spark, folder) for _ in range(RUNS)), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}
        )
    )


if __name__ == "__main__":
    main()
