"""Times the 22 query shapes at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

For each query: end-to-end seconds (optimising, planning, scan and result included), the best of RUNS
after WARMUPS runs of the whole set; and the same with the tables cached in memory. Analysed plans are
kept from the first run on, as the engine's plan cache keeps them; no run reuses what another computed.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import time

RUNS, WARMUPS = 2, 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    from lodestar import registry
    from lodestar.sources import catalog
    from lodestar.sources.plans import PlanCache

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).config("spark.sql.files.openCostInBytes", "1m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [f"tpch_q{k}" for k in range(1, 23)]
    made, held_plans = registry.queries(), PlanCache(spark)

    def once(name: str) -> float:
        began = time.perf_counter()
        held_plans.get(name, made[name], sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    def best(warmups: int) -> dict[str, float]:
        times: dict[str, list[float]] = {n: [] for n in names}
        for k in range(warmups + RUNS):
            for n in names:
                seconds = once(n)
                if k >= warmups:
                    times[n].append(seconds)
        return {n.removeprefix("tpch_"): round(min(x), 4) for n, x in times.items()}

    with contextlib.redirect_stdout(io.StringIO()):
        end_to_end = best(WARMUPS)
        held = {n: catalog.table(spark, sf_dir, n).cache() for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
        for t in held.values():
            t.count()
        cached = best(1)
    out = {"metric": "sum of the 22 query shapes, end to end", "value": round(sum(end_to_end.values()), 3), "unit": "sec", "queries": end_to_end, "sf": os.path.basename(sf_dir.rstrip("/"))}
    out |= {"cached_value": round(sum(cached.values()), 3), "cached_queries": cached, "warmups": WARMUPS, "runs": RUNS, "cores": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
