"""Command line: python -m lodestar --sf-dir DIR [--q NAME ...] [--sql FILE] [--warmup N] [--times FILE] [--plan] [--check]."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from lodestar import registry
from lodestar.check import differences
from lodestar.sources import sinks
from lodestar.sources.sql import run_file


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="lodestar", description="Run registered queries or a SQL file over a directory of tables.")
    args.add_argument("--sf-dir", required=True, help="directory with <table>.parquet")
    args.add_argument("--q", nargs="*", default=[], help="registered names; a number n stands for tpch_qn; none: all 22")
    args.add_argument("--sql", help="a file with a query to run instead")
    args.add_argument("--warmup", type=int, default=0, help="runs before the one that counts")
    args.add_argument("--times", help="CSV file to append seconds to")
    args.add_argument("--metrics", help="JSON file for the plan's metrics by operator and the stages' times and bytes; FILE.trace gets a time line")
    args.add_argument("--check", action="store_true", help="compare the results with those of each query's SQL on another database")
    args.add_argument("--out", help="directory to write each result to, as Parquet")
    args.add_argument("--plan", action="store_true", help="print the physical plans")
    args.add_argument("--quiet", action="store_true", help="print no rows")
    a = args.parse_args(argv)
    spark = SparkSession.builder.appName("lodestar").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made = registry.queries()
    if a.sql:
        made, names = {a.sql: lambda s, d: run_file(s, d, a.sql)}, [a.sql]
    else:
        names = [f"tpch_q{q}" if q.isdigit() else q for q in a.q] or [f"tpch_q{k}" for k in range(1, 23)]
    if a.check:
        found = differences(spark, a.sf_dir, names)
        for name, what in found.items():
            print(f"{name}: {what or 'equal'}")
        if any(found.values()):
            raise SystemExit(1)
        return
    measured = {}
    for name in names:
        for _ in range(a.warmup):
            made[name](spark, a.sf_dir).write.format("noop").mode("overwrite").save()
        began = time.time()
        df = made[name](spark, a.sf_dir).persist()  # what is shown and written is not computed again, nor brought here
        n = df.count()
        seconds = time.time() - began
        print(f"{name}: {n} rows, {seconds:.3f} s")
        if not a.quiet:
            print(sinks.head_text(df))
        if a.times:
            sinks.append_times(a.times, [(a.sf_dir, name, f"{seconds:.6f}")])
        if a.out:
            sinks.write_table(df, f"{a.out}/{name}")
        df.unpersist()
        if a.plan:
            made[name](spark, a.sf_dir).explain("formatted")
        if a.metrics:  # of a run of its own, as a held result has no plan to measure
            own = made[name](spark, a.sf_dir)
            with sinks.Stages(spark) as stages:
                sinks.execute(own)
            measured[name] = {"operators": sinks.metrics(own), "stages": stages.found}
    if a.metrics:
        sinks.write_json(a.metrics, measured)
        sinks.write_json(f"{a.metrics}.trace", sinks.trace([x for m in measured.values() for x in m["stages"]]))


if __name__ == "__main__":
    main()
