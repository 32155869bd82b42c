"""Headline queries, timed once each from plan building to the last row."""

from __future__ import annotations

import json
import os
import sys
import time

from labelspark.plans.queries import QUERIES
from labelspark.session import local_session

HEADLINE = [
    "line_blocks", "deduplicated_blocks", "verify_labels", "verify_from_words",
    "documents_with_passages", "document_words", "name_similarity", "order_totals",
    "current_decisions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 2),
                "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
