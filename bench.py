"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioscope import plans  # noqa: E402
from folioscope.session import build_session  # noqa: E402

HEADLINE = [
    "semantic_type", "detect_language", "keywords", "chunk_build", "bm25_search", "hybrid_search", "knn_exact",
    "assemble_context", "extract_citations", "find_spans", "sentence_overlap", "edges_final", "components",
    "catalog_listing", "feedback_stream", "ingest_stream", "shortest_path", "related_chunks", "graph_stats", "k_hop",
    "semantic_edges", "should_highlight", "best_section",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/region.parquet").count()  # start-up is not part of any query
    times = {}
    for name in names:
        start = time.time()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
