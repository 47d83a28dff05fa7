"""Headline queries, timed: `python bench.py` prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query runs to its last row
(a sink that keeps nothing), so no result passes through the driver.
"""

from __future__ import annotations

import json
import os
import time

from vicinage.plans.checks import all_checks
from vicinage.plans.views import Tables
from vicinage.session import local_session

HEADLINES = [
    "p05_filter_listings", "p14_search_documents", "o06_month_groups", "a18_co_located", "w01_dedupe_places",
    "j03_canonical_towns", "j04_towns_in_text", "j06_nearest_commune", "j07_assign_region", "j08_radius_join",
    "j17_score_all", "w05_for_you", "w04_collapse_similar", "s02_open_data_json", "s04_json_ld", "s10_detail_links",
    "s15_insert_new", "s16_upsert", "q13_build_listings", "q07_clean_texts", "q08_safety_audit", "f25_distance_to_path",
    "g01_simplify", "q11_route_geometry", "t01_dedupe_pings", "t04_featured_until",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="20g")
    checks = all_checks()
    tables = Tables(spark, folder)
    tables.lineitem.count()  # JVM and parquet readers warm before the first timing
    times: dict[str, float] = {}
    for name in HEADLINES:
        started = time.time()
        checks[name].run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
