"""Times the headline queries; prints one JSON line.

Every query is run once on the smallest data to start the workers and compile, then timed from
building the plan to the last row. ``contacts`` are imported (table written) by the first
statistics query; that import is timed as its own entry.
"""

import json
import os
import sys
import time

from skylog.plans import catalog
from skylog.session import local_session

HEADLINE = [
    "normalize_rows",
    "cty_lookup",
    "adif_scan",
    "wsjtx_decode",
    "share_by_continent_band",
    "stats_summary",
    "stats_grouping_sets",
    "longest_qso",
    "dedup_first",
    "qso_insert",
    "recalculate",
    "great_circle",
    "qso_path",
    "grid_cells",
    "client_sessions",
    "bounding_arc",
]


def run(spark, name, sf):
    started = time.perf_counter()
    # the raw log normalised with lookup; the registered normalize_log reads the stored contacts
    frame = catalog.rows(spark, sf) if name == "normalize_rows" else catalog.QUERIES[name](spark, sf)
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    spark = local_session(cores, "bench", **{
        "spark.sql.shuffle.partitions": cores, "spark.driver.memory": "6g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalog.SPREAD = int(cores)  # events.parquet is one row group
    names = sys.argv[1:] or HEADLINE
    for name in names:
        run(spark, name, small if os.path.isdir(small) else sf)
    started = time.perf_counter()
    for countries in (True, False):
        catalog.contacts(spark, sf, countries)
    times = {"import_contacts_twice": round(time.perf_counter() - started, 3)}
    for name in names:
        times[name] = round(run(spark, name, sf), 3)
    rows = spark.read.parquet(f"{sf}/events.parquet").count()
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "contacts": rows,
        "contacts_per_s": {k: round(rows / v) for k, v in times.items()},
    }))


if __name__ == "__main__":
    main()
