"""Near-duplicate detection by SimHash fingerprints linked through sharded BK-trees.

A fingerprint has 64 bits; bit i is set if it is set in over half of the XXH64 hashes of the
document's 3-word shingles. Fingerprints with 3 or fewer differing bits are linked, and components
of links are the near-duplicate groups.

Linking works on distinct fingerprints, so exact copies cost nothing. Shards follow from the
pigeonhole rule: of 4 blocks of the bits, two linked fingerprints agree in at least one, so each
fingerprint goes to 4 shards, one for each block's value, and no link is lost. A shard of more
than ``SHARD`` fingerprints is split again by 4 blocks of the bits left, up to 5 times; then at
most 2**16 fingerprints can share a shard, so a shard's size is bounded whatever the data are.
Each shard is a BK-tree: a child hangs on the edge of its Hamming distance to the parent, and a
search at distance d from a node follows only the edges from d - 3 to d + 3. The trees of all
shards of a task are flat arrays which are searched together. A shard sends a spanning forest of
its links, never all pairs.

A shard tree meets only its own members as queries, so it travels with them in one shuffle instead
of a broadcast to all tasks: all trees together grow with the corpus and have no bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._common import Workspace, read, schema, texts
from lodestar.llm.components import components

RADIUS = 3
SHARD = 4096
LEVELS = 5
SHINGLE = 3
SEED = 42


def fingerprint(text: bytes) -> int:
    """The SimHash of a text in UTF-8, unsigned; 0 for a text without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= SHINGLE:
        digests, m = digest(joined, SEED), 1
    else:
        m = n - SHINGLE + 1
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = [0, *ends[: m - 1].tolist()]
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)])
    ones = np.zeros(64, np.int64)
    raw = np.frombuffer(digests, np.uint8).reshape(m, 8)
    for a in range(0, m, 1 << 16):
        ones += np.unpackbits(raw[a : a + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def fingerprints(documents: DataFrame, keep: list[str], name: str = "fp") -> DataFrame:
    """The columns ``keep`` and the fingerprint (as a signed long) of each row's text; a null text has no words."""
    rows = documents.select(*keep, F.col("text").alias("__text"))
    at = len(keep)

    def scan(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in texts(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found)], [*keep, name])

    return rows.mapInArrow(scan, schema(rows, keep, f"`{name}` long"))


def left_bits(path: int, level: int) -> list[int]:
    """The bits that the blocks chosen along a path of ``level`` steps leave over."""
    bits = list(range(64))
    for step in range(level):
        block = blocks(bits)[(path >> (2 * step)) & 3]
        bits = [b for b in bits if b not in block]
    return bits


def blocks(bits: list[int]) -> list[list[int]]:
    cut = [round(len(bits) * k / (RADIUS + 1)) for k in range(RADIUS + 2)]
    return [bits[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def split(rows: DataFrame, level: int) -> DataFrame:
    """(path, value, fp) of shards of a level into the 4 shards each of the next level; level 0 has path and value 0."""

    def scan(batches):
        for batch in batches:
            path, value, fp = (batch.column(c).to_numpy() for c in ("path", "value", "fp"))
            for p in np.unique(path).tolist():
                own = path == p
                bits, v, base = fp[own].view(np.uint64), value[own], left_bits(p, level)
                for j, block in enumerate(blocks(base)):
                    more = np.zeros(len(bits), np.uint64)
                    for k, b in enumerate(block):
                        more |= ((bits >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), p | j << (2 * level), np.int64)), pa.array((v << len(block)) | more.astype(np.int64)), pa.array(bits.view(np.int64))], ["path", "value", "fp"])

    return rows.mapInArrow(scan, "path long, value long, fp long")


class Forest:
    """BK-trees of several shards as flat arrays. shard: sorted numbers; fp: distinct within a shard, ascending."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp, n = fp, len(fp)
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        waiting, under = np.flatnonzero(~first), self.root[~first]
        keys, nodes = [], []
        while len(waiting):  # one level of all trees: the first at each (parent, distance) becomes the child there
            key = under * 65 + np.bitwise_count(fp[waiting] ^ fp[under])
            order = np.argsort(key, kind="stable")
            waiting, key = waiting[order], key[order]
            child = np.concatenate([[True], key[1:] != key[:-1]])
            keys.append(key[child])
            nodes.append(waiting[child])
            under = waiting[child][np.cumsum(child) - 1][~child]
            waiting = waiting[~child]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.edge, self.child = key[order], (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def near(self, query: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all members of the query's own shard within the radius, itself left out."""
        q, node, found = query, self.root[query], []
        while len(q):
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            found.append((q[hit], node[hit]))
            a = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right") - a
            q = np.repeat(q, n)
            node = self.child[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(q))]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def forest_links(shard: np.ndarray, fp: np.ndarray, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within shards: each fingerprint with a smaller one of its component."""
    trees, n = Forest(shard, fp), len(fp)
    label = np.arange(n)
    size = np.bincount(trees.root, minlength=n)[trees.root] if n else np.zeros(0, np.int64)
    work = np.cumsum(size)
    a = 0
    while a < n:  # so many queries at a time that they can meet no more than about `most` nodes
        b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + most, "right")))
        x, y = trees.near(np.arange(a, min(b, n)))
        while len(x):
            lx, ly = label[x], label[y]
            differ = lx != ly
            x, y, lx, ly = x[differ], y[differ], lx[differ], ly[differ]
            np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
            while not np.array_equal(up := label[label], label):
                label = up
        a = b
    own = np.flatnonzero(label != np.arange(n))
    return fp[own], fp[label[own]]


def _link_shards(rows: DataFrame) -> DataFrame:
    """Links (a, b) of (path, value, fp), whose shards lie together in a partition, sorted."""

    def scan(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(table):
            path, value, fp = (table.column(c).to_numpy() for c in ("path", "value", "fp"))
            new = np.concatenate([[True], (path[1:] != path[:-1]) | (value[1:] != value[:-1])])
            a, b = forest_links(np.cumsum(new), fp.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 18:  # solve all whole shards, keep the last, which may go on
                table = pa.Table.from_batches(held).combine_chunks()
                path, value = table.column("path").to_numpy(), table.column("value").to_numpy()
                cut = int(np.flatnonzero((path != path[-1]) | (value != value[-1]))[-1]) + 1 if (path[0], value[0]) != (path[-1], value[-1]) else 0
                if cut:
                    yield solve(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = table.num_rows - cut
        if size:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(scan, "a long, b long")


def link(ws: Workspace, distinct: DataFrame, most: int = SHARD) -> DataFrame:
    """(fp, label) for the fingerprints of the table (fp, distinct) that have links: label names the component."""
    rows = split(distinct.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("value"), "fp"), 0)
    found = None
    for level in range(1, LEVELS + 1):
        rows = ws.save(rows, f"shards-{level}")
        large = ws.save(rows.groupBy("path", "value").count().filter(F.col("count") > most).select("path", "value"), f"large-{level}") if level < LEVELS else None
        split_more = large is not None and large.limit(1).count() > 0
        now = rows.join(large, ["path", "value"], "left_anti") if split_more else rows
        now = now.select("path", "value", "fp").repartition("path", "value").sortWithinPartitions("path", "value", "fp")
        links = ws.save(_link_shards(now).distinct(), f"links-{level}")
        found = links if found is None else found.union(links)
        if not split_more:
            break
        rows = split(rows.join(large, ["path", "value"], "left_semi").select("path", "value", "fp"), level)
    return components(ws, found).select(F.col("node").alias("fp"), "label")


def groups(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach, itself included).

    A null or empty text has fingerprint zero and is linked like any other. Repeated rows and equal
    ids each get their row. A null id takes part in linking; the component_id is the smallest id that
    is not null, or null where all are. An empty table gives an empty result. Other columns are ignored.
    """
    ws = Workspace(spark, "simhash")
    prints = ws.save(fingerprints(documents, ["doc_id"]), "prints")
    return _named(ws, prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _named(ws: Workspace, prints: DataFrame) -> DataFrame:
    each = ws.save(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct")
    linked = link(ws, each.select("fp"))
    label = ws.save(each.join(linked, "fp", "left").select("fp", "smallest", F.coalesce("label", "fp").alias("label")), "labelled")
    names = label.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = label.join(names, "label").select("fp", "component_id")
    return prints.join(named, "fp")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the whole documents table."""
    return groups(spark, read(spark, sf_dir, "documents"))


def dedup(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """One document of each group: the smallest doc_id (nulls last), the first of equal rows; all columns stay.

    The rows get a number in a written table, so that one of equal rows can be told from the others.
    """
    ws = Workspace(spark, "simhash-dedup")
    uid, fp = (next(x for x in (f"__{n}", f"__{n}_", f"__{n}__") if x not in documents.columns) for n in ("uid", "fp"))
    numbered = ws.save(documents.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    prints = ws.save(fingerprints(numbered.withColumnRenamed(uid, "uid") if "uid" not in documents.columns else numbered.withColumn("uid", F.col(uid)), ["uid", "doc_id"]), "prints")
    each = ws.save(prints.select("fp").distinct(), "distinct")
    linked = link(ws, each)
    stays = prints.join(linked, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")).alias("x")).select(F.col("x.uid").alias(uid))
    return numbered.join(stays, uid, "left_semi").select(*documents.columns)
