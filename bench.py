"""Time the headline queries on local[BENCH_CPUS]; prints one JSON line.

Every query is run to its last row (the ``noop`` sink). ``BENCH_SF_DIR`` names
the tables and ``BENCH_QUERIES`` picks queries by name.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES  # noqa: E402
from docketry.session import local_session  # noqa: E402

HEADLINE = [
    "cosine_topk", "cosine_topk_grid", "cosine_topk_single", "search_normal", "search_fast",
    "pack_text", "sections", "heading_frequency", "assess", "grounding", "document_terms",
    "term_frequency", "encode_documents", "align", "new_decisions", "dedupe_keep_first",
    "merge_store", "assign_batches", "delta_index", "embedding_profile", "sanitize_normalize",
    "quality_report", "claim_sources", "generate_cards",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM and the Python workers before the clock runs.
    spark.range(64).mapInArrow(lambda batches: batches, "id long").count()
    times = {}
    for name in names.split(",") if names else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:24} {times[name]:8.2f}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).strip("sf"),
        "cpus": cpus}))


if __name__ == "__main__":
    main()
