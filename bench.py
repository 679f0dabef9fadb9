"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f11_c03_block_quality", "c01_packed_chunks", "c02_window_chunks", "a11_c04_parent_chunks",
    "r02_bm25", "r06_cosine", "r11_hybrid_search", "r12_p04_keyword_fallback",
    "p01_readable_files", "t04_newest_files", "g02_j16_edges", "g04_shortest_paths",
    "a01_file_counts", "a03_a05_online_summary", "c07_w05_schedule_blocks", "j15_drawing_edges",
    "m01_stream_ingest", "m11_stream_monitor",
]


def main() -> None:
    from marginalia.plans import registry
    from marginalia.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("count(*)").collect()  # start the JVM side
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
