"""Connected components of a graph given as a table of links, in a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm._common import Workspace


def components(ws: Workspace, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) for each node of links (a, b): the smallest node that can be reached.

    Rounds of hooking and pointer jumping: for each link the other end's label is offered to this
    end and to this end's label, each node takes the smallest offer, then its label's label. The
    number of rounds grows with the logarithm of a component's diameter. Sums by node have partial
    aggregation, so a node with very many links is no hot task; what joins on a common label is a
    plain equi-join, which adaptive execution splits. Each round is a written table. Only the
    number of labels that changed goes to the driver. An empty table of links gives an empty result.
    """
    both = ws.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-links")
    label = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    k = 0
    while True:
        one = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
        two = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        offers = both.join(one, "a").join(two, "b").filter("la <> lb").select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("lb").alias("label")), F.struct(F.col("la").alias("node"), F.col("lb").alias("label")))).alias("x")).select("x.*")
        best = offers.union(label).groupBy("node").agg(F.min("label").alias("label"))
        best = ws.save(best, f"{name}-hook-{k}")
        up = best.select(F.col("node").alias("label"), F.col("label").alias("up"))
        old = label.select("node", F.col("label").alias("old"))
        new = ws.save(best.join(up, "label").select("node", "up").join(old, "node").select("node", F.col("up").alias("label"), (F.col("up") != F.col("old")).alias("moved")), f"{name}-{k + 1}")
        moved = new.filter("moved").count()
        ws.drop(f"{name}-hook-{k}", f"{name}-{k}")
        label, k = new.select("node", "label"), k + 1
        if not moved:
            ws.drop(f"{name}-links")
            return label
