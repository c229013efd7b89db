"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from movespark.session import SETTINGS

HEADLINE = ("split_st", "track_meta", "speed_mid", "coursing_mid", "turning_rate", "sinuosity_w5", "classify_stops", "classify_polygons", "time_in_polygon", "resample_time", "resample_global",
            "smooth_corners", "encounters", "intersections", "proximities", "flow_map", "lateral_hist", "rasterize_count", "to_lines", "agent_meta", "decimate")


def main() -> None:
    from pyspark.sql import SparkSession

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=SETTINGS | {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from movespark.plans.queries import QUERIES

    QUERIES["track_meta"](spark, sf).write.format("noop").mode("overwrite").save()  # starts executors, compiles
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
