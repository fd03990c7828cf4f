"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local threads, BENCH_QUERIES an optional comma-separated choice.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from coratia.catalogue import QUERIES
from coratia.session import build_session

HEADLINE = [
    "count_positive",
    "count_equal",
    "max_text_len",
    "distinct_users",
    "distinct_items",
    "top20_users",
    "top20_items",
    "review_summary",
    "avg_by_state",
    "top5_state",
    "baskets_filtered",
    "frequent_itemsets",
    "frequent_itemsets_filtered",
    "itemset_report",
    "minhash_signatures",
    "jaccard_exact",
    "jaccard_lsh",
    "last_ratings",
    "pearson_items",
    "cf_item",
    "cf_user",
    "als_predict",
    "co_graph",
    "components",
    "edge_betweenness",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    threads = os.cpu_count() or 8 if cpus == "*" else int(cpus)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        threads * int(os.environ.get("BENCH_SPREAD", "1")),
        {"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
