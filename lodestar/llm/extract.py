"""Main-text extraction with consensus paths per host.

Each page's containers are scored by their paragraphs, and the best one votes for its generalised
path: tags with classes from the root, numbers taken out. Votes are summed per host and path in
Spark. Then each page is extracted at the path that its host chose, so that a page whose own best
container is wrong (a long notice, a short article) still gives the article. All elements at the path
are taken, and the article that they are parts of is completed from what is around them, as a nested
container scores above the one that holds all sections. A page that lacks the path, or has no text
there, falls back to its own best container, and then to what its body holds, if that is not mostly links.

Pages are read twice and not shuffled for the votes: a task sends one row per host and path. The
winners are one row per host; adaptive execution broadcasts them while they are below the session's
limit and otherwise joins by host, splitting a host that very many pages share.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import html as H
from lodestar.llm._common import Workspace, read, runs, schema, texts


def host() -> F.Column:
    """The host of a url in lower case, without a user or port; null if it has none."""
    found = F.lower(F.regexp_extract(F.col("url"), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(found) > 0, found)


def vote(pages: DataFrame) -> DataFrame:
    """(host, path): the path that wins each host, by votes, then by summed score, then by name. Pages without a host do not vote."""
    rows = pages.select(host().alias("host"), "html").filter("host is not null and html is not null")

    def scan(batches):
        held: dict[tuple[str, str], list] = {}

        def flush():
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held]), pa.array([p for _, p in held]), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([s for _, s in held.values()], pa.float64())], ["host", "path", "votes", "score"])
                held.clear()

        for batch in batches:
            hosts = batch.column("host").to_pylist()
            for k, raw in enumerate(texts(batch.column("html"))):
                found = H.best(H.parse(raw.decode("utf-8", "replace")))
                if found:
                    score, node = found
                    x = held.setdefault((hosts[k], node.path()), [0, 0.0])
                    x[0] += 1
                    x[1] += round(score, 3)
            if len(held) > 50_000:
                yield from flush()
        yield from flush()

    sums = rows.mapInArrow(scan, "host string, path string, votes long, score double").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.round(F.sum("score"), 3).alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("x")).select("host", "x.path")


def main_text(raw: str, path: str | None) -> str:
    """The blocks of the article, joined by newlines; empty if the page has none."""
    root = H.parse(raw)
    tried = set()
    for find in (lambda: H.at_path(root, path) if path else [], lambda: H.at_path(root, own[1].path()) if (own := H.best(root)) else [], lambda: [root]):
        nodes = find()
        if not nodes or tried.issuperset(map(id, nodes)):
            continue
        tried.update(map(id, nodes))
        if nodes == [root] and H.linked(root):
            return ""  # a menu and no article
        if any(map(H.blocks, nodes)):
            return "\n".join(H.article(nodes))
    return ""


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points), path (that the host chose, null if none).

    A null or empty html gives an empty text. A page without a host is extracted by its own scores.
    Null ids stay null, repeated rows each get their row (and their vote). An empty table gives an
    empty result. Other columns are ignored.
    """
    ws = Workspace(spark, "extract")
    winners = ws.save(vote(pages), "winners")
    rows = pages.select("page_id", "url", F.col("html").alias("__html"), host().alias("__host"))
    chosen = rows.join(winners.select(F.col("host").alias("__host"), F.col("path").alias("__path")), "__host", "left").select("page_id", "url", "__html", "__path")

    def scan(batches):
        for batch in batches:
            for a, b in runs(batch.column("__html")):
                part = batch.slice(a, b - a)
                found = [main_text(raw.decode("utf-8", "replace"), p) for raw, p in zip(texts(part.column("__html")), part.column("__path").to_pylist(), strict=True)]
                found = [x.encode("utf-8", "replace").decode() for x in found]  # a reference to half a surrogate pair is no text
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64()), part.column("__path")], ["page_id", "url", "text", "n_chars", "path"])

    return chosen.mapInArrow(scan, schema(chosen, ["page_id", "url"], "text string, n_chars long, path string"))


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages table."""
    return extract(spark, read(spark, sf_dir, "pages"))
