"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], in a warm session; prints one JSON line.

The indexes are built once, timed apart under `build`; queries then read them.
"""

import json
import os
import time

from sparkrag.plans import retrieval
from sparkrag.plans.queries import QUERIES
from sparkrag.session import session

NAMES = ("bm25_topk", "bm25_benchmark", "dense_topk_batch", "dense_topk_hundredth", "rrf_hybrid", "tokenize_counts", "forum_chunks", "chat_sessions_gap_cap", "percentiles", "label_coverage", "exact_dups")


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the workers and compiles common code; no query is run for it.
    retrieval.table(spark, sf_dir, "documents").selectExpr("sum(length(text))").collect()
    start = time.time()
    retrieval.lexical_index(spark, sf_dir)
    build = {"bm25_index": round(time.time() - start, 3)}
    start = time.time()
    retrieval.hashed_index(spark, sf_dir)
    build["hashed_index"] = round(time.time() - start, 3)
    seconds = {}
    for name in NAMES:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "build": build, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
