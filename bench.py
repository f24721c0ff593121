"""Headline queries, wall time, one JSON line.

Each query is built and run to completion through the `noop` sink; the median of the repeats is
reported. Each time is told on stderr as it is known; a query that fails stands under `errors` and the
others go on. BENCH_SF_DIR, BENCH_CPUS, BENCH_REPEATS and BENCH_QUERIES (comma-separated) override the
defaults.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventide.checks.queries import QUERIES  # noqa: E402

HEADLINE = ("scored_board", "event_returns", "financials_asof", "insiders_asof",
            "runway_study_events", "runway_study", "headline_hits", "therapeutic_areas",
            "fuzzy_dates", "sponsor_tickers", "realised_outcomes", "current_financials")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times, errors = {}, {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        runs = []
        try:
            for _ in range(repeats):
                t = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t)
            times[name] = round(statistics.median(runs), 3)
        except Exception as e:  # one failure must not hide the other figures
            errors[name] = str(e).split("\n")[0][:300]
        print(name, times.get(name, "failed"), [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_median_wall", "unit": "sec",
                      "value": round(sum(times.values()), 3), "queries": times,
                      **({"errors": errors} if errors else {}),
                      "sf": os.path.basename(sf_dir), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
