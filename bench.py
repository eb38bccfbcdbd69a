"""Times the headline queries: one warm-up, then the median of three runs; prints one line of JSON."""

import json
import os
import statistics
import time

from tidemill import session
from tidemill.plans import registry

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("q1_daily", "q1_weekly_sliding", "q1_alltime", "q2_hourly_tumbling", "q2_hourly_sliding", "q2_daily_sliding", "q2_daily_sliding_direct", "q2_weekly_sliding", "q2_daily_rollup", "q3_hourly_tumbling", "q3_daily_sliding", "q3_weekly_sliding", "q3_daily_rollup", "stream_q2_hourly")


def main() -> None:
    spark = session.build("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    found, queries = {}, registry.queries()
    for name in HEADLINE:
        runs = []
        for _ in range(2 if name.startswith("stream_") else 4):
            began = time.perf_counter()
            queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        found[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
