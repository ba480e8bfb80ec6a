"""Time every query and print one JSON line: ``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores."""

from __future__ import annotations

import json
import os
import sys
import time

from tillwise.plans.queries import QUERIES
from tillwise.session import session

# Which queries make up the headline number; the others are timed beside them.
HEADLINE = (
    "executive_snapshot", "cash_eaters", "low_margin_products", "sku_velocity", "median_price", "free_up_cash",
    "reorder_plan", "reorder_plan_by_nation", "processed_transactions", "text_outline",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(QUERIES)
    QUERIES["cash_eaters"](spark, folder).write.format("noop").mode("overwrite").save()  # warms up the JVM
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_wall_time",
                "value": round(sum(seconds.get(name, 0.0) for name in HEADLINE), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "spark": spark.version,
                "master": spark.sparkContext.master,
                "shuffle_partitions": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
