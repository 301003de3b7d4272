"""Seconds of the headline queries, as one line of JSON: the median of 3 runs after a warm-up."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from brindle import registry
from brindle.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = "pricing_summary six_way_join count_distinct rollup_totals percentiles ranks rows_frame range_interval lateral_topk asof_join range_bucket_join merge_clauses sessionize connect_by_path pivot_status match_recognize_v mongo_group es_bool cosine_topk regexp_functions".split()


def main() -> None:
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    known, took = registry.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            known[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
