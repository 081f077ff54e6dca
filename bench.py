"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from veilframe.plans import all_queries
from veilframe.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = os.environ.get("BENCH_QUERIES", "sanitize_documents d2_document_hits d2_page_hits r1_resolved_spans "
                          "r25_evaluate_records r25_evaluate_json w1_limiter a1_requests_total t10_argument_checks "
                          "l1_chat_validation e5_detection_metrics n5_bio_spans").split()


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = all_queries()
    spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    times = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        best = None
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
