"""Sinks for results and run statistics."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, kind: str = "parquet", **options: str) -> None:
    """Write a result with Spark's own writers (parquet, orc, csv, json)."""
    df.write.mode("overwrite").options(**options).format(kind).save(path)


def head_text(df: DataFrame, n: int = 5) -> str:
    """The first n rows as text, numbers with six digits."""
    rows = df.limit(n).collect()
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    table = [df.columns, *[[cell(v) for v in r] for r in rows]]
    widths = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in table)


def append_times(path: str, rows: list[tuple]) -> None:
    """Append (data, query, seconds) rows to a CSV file, with a header in a new one."""
    new = not os.path.exists(path)
    with open(path, "a", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        if new:
            out.writerow(["data", "query", "seconds"])
        out.writerows(rows)


def metrics(df: DataFrame) -> dict[str, dict[str, int]]:
    """The SQL metrics of an executed plan by operator: rows, bytes, times. Run the frame first, on this same object."""
    found: dict[str, dict[str, int]] = {}

    def walk(node, at):
        values = {}
        names = node.metrics().keysIterator()
        while names.hasNext():
            name = names.next()
            values[name] = node.metrics().apply(name).value()
        found[f"{at:02d} {node.nodeName()}"] = values
        children = list(node.children().mkString("\n") and [node.children().apply(i) for i in range(node.children().size())])
        if node.nodeName() == "AdaptiveSparkPlan":
            children = [node.executedPlan()]
        elif hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            children = [node.plan()]
        for child in children:
            at = walk(child, at + 1)
        return at

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return found


def execute(df: DataFrame) -> None:
    """Run a frame's own plan to its end, all rows, without bringing them anywhere; its metrics are filled."""
    df._jdf.queryExecution().toRdd().count()


class Stages:
    """The stages that run within a ``with`` block: times, rows, bytes read and moved (``found``)."""

    def __init__(self, spark: SparkSession):
        self.context, self.found = spark.sparkContext._jsc.sc(), []
        self.none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def _now(self) -> list:
        self.context.listenerBus().waitUntilEmpty()
        every = self.context.statusStore().stageList(None, False, False, self.none, None)
        return [every.apply(i) for i in range(every.size())]

    def __enter__(self):
        self.before = {(x.stageId(), x.attemptId()) for x in self._now()}
        return self

    def __exit__(self, *_):
        for x in self._now():
            if (x.stageId(), x.attemptId()) in self.before or not x.completionTime().isDefined() or not x.submissionTime().isDefined():
                continue
            start, end = x.submissionTime().get().getTime(), x.completionTime().get().getTime()
            self.found.append({"stage": x.stageId(), "attempt": x.attemptId(), "name": x.name(), "tasks": x.numTasks(), "start_ms": start, "ms": end - start, "input_bytes": x.inputBytes(), "shuffle_read_bytes": x.shuffleReadBytes(), "shuffle_write_bytes": x.shuffleWriteBytes(), "spilled_bytes": x.diskBytesSpilled()})
        self.found.sort(key=lambda x: (x["start_ms"], x["stage"]))


def trace(stages: list[dict]) -> dict:
    """Stages in the trace-event format that browsers show on a time line."""
    return {"traceEvents": [{"name": f"{x['stage']} {x['name']}", "ph": "X", "ts": x["start_ms"] * 1000, "dur": x["ms"] * 1000, "pid": 0, "tid": x["stage"], "args": x} for x in stages]}


def write_json(path: str, value) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=1)
