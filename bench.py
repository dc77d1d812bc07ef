"""Time the headline queries and print one JSON line.

Every query runs once to warm up and then RUNS times; its time is the median of those. All rows
are computed (written to a sink that drops them). Rates are rows of the input tables and emitted
triples per second of the graph builds.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pagegraph.plans import all_queries  # noqa: E402
from pagegraph.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "flagship_days_diff",
    "triples_from_rows",
    "triples_from_variant",
    "triples_typed_inferred",
    "link_triples",
    "sitelink_triples",
    "profile_dynamic",
    "graph_signature",
    "payload_direct",
    "header_rows",
    "title_norm",
    "new_pages",
    "edited_pages",
    "latest_contrib",
    "g_group",
    "g_exists",
    "federated_join",
]
# records read and the query that emits one row per triple
BUILDS = {"triples_from_rows": "customer", "triples_from_variant": "customer", "triples_typed_inferred": "events"}


def run_once(query, spark):
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master="local[{}]".format(CPUS),
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times, rates = {}, {}
    for name in names:
        run_once(queries[name], spark)
        times[name] = round(statistics.median(run_once(queries[name], spark) for _ in range(RUNS)), 3)
        if name in BUILDS:
            records = spark.read.parquet("{}/{}.parquet".format(SF_DIR, BUILDS[name])).count()
            triples = queries[name](spark, SF_DIR).count()
            rates[name] = {"records_per_sec": round(records / times[name]), "triples_per_sec": round(triples / times[name])}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
                "runs": RUNS,
                "rates": rates,
            }
        )
    )


if __name__ == "__main__":
    main()
