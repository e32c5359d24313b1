"""Time the registered queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores. Each query
runs to completion into a sink that keeps nothing; ``BENCH_ALL=1`` times every
registered query instead of the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import Observation
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from askmill.plans.registered import QUERIES  # noqa: E402
from askmill.session import new_session  # noqa: E402

HEADLINE = [
    "chunk_documents",
    "chunk_stats_by_lang",
    "word_hash_buckets",
    "hash_embed_norm",
    "knn_top4",
    "retrieve_chunks",
    "rag_context",
    "rag_prompt",
    "tool_enrich_asof",
    "judge_prompt",
    "judge_similarity",
    "report_rows",
    "report_pivot",
    "index_sync",
    "answer_flow",
    "judge_flow",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = new_session("bench", cores=cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the Python workers and load the classes once, outside the timings.
    QUERIES["retrieve_chunks"](spark, sf_dir).limit(1).collect()
    seconds, rates = {}, {}
    for name in names:
        seen = Observation()
        begun = time.perf_counter()
        counted = QUERIES[name](spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
        rates[name] = round(seen.get["rows"] / seconds[name], 1)
        print(name, seconds[name], f"{rates[name]} rows/s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
