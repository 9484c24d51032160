"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lectern.plans import QUERIES
from lectern.session import local_session

HEADLINE = [
    "vector_topk", "vector_topk_scoped", "lexical_search", "hybrid_search", "evidence_selection", "evidence_budget",
    "document_chunks", "structured_clean_text", "searchable_documents", "html_page_text", "token_counts",
    "duplicate_uploads", "report_blocks", "routed_turns", "best_context", "latest_rows", "grounding_share",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM and one Python worker before the clock runs.
    spark.range(1000).mapInPandas(lambda it: it, "id bigint").count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
