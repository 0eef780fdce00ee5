"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 13 consecutive words of the benchmark's items (a shorter item is
one window). Words are the symbols: each word of the benchmark has a number, every other word is
0. For each pattern length m the search looks at blocks of B = 2 words (1 where m is 1). A SHIFT
table, filled by block hash, says how far the window may move at least; only where it says 0 does
the bucket of the block's suffix hash name the patterns whose last words may match, and a direct
comparison of all m words confirms each of them. Most positions are never looked at.

The search runs over many documents at once: a document is cut into overlapping lanes, whose
cursors move in step by numpy. Nothing is sampled; every occurrence is found.

Documents are only scanned: no shuffle, and memory is bounded by the Arrow batch. The patterns of a
block of at most ``block_bytes`` of the benchmark are made into arrays once, on the driver, and are
broadcast: the numbers of all words in order, of which a pattern is a place, the tables, and the words
themselves, which a worker puts into a dictionary when it first sees the block. A larger benchmark is
read, searched and let go block by block; the hits, written to a table, are merged per document.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._common import Workspace, read, runs, texts

WINDOW = 13
LANE = 256
_SPACE = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Lower-case words of a text: ASCII digits and letters and all characters past ASCII."""
    return text.translate(_SPACE).split()


class WuManber:
    """Patterns of one length m: places (distinct ones) in an array of word numbers above 0."""

    def __init__(self, words_: np.ndarray, places: np.ndarray, m: int):
        self.words, self.places, self.m, self.block = words_, places.astype(np.int32), m, min(2, m)
        self.bits = min(22, max(8, int(len(places) * m).bit_length() + 1))  # as many entries as blocks, or some MB
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int8)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, self._at(places, end), np.int8(m - end))
        suffix = self._at(places, m)
        self.order = np.argsort(suffix, kind="stable").astype(np.int32)
        self.start = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _at(self, places: np.ndarray, end: int) -> np.ndarray:
        """The hash of the block that ends a pattern's first ``end`` words."""
        return self._hash(self.words[places + end - 2] if self.block == 2 else None, self.words[places + end - 1])

    def _hash(self, first: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        h = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if first is not None:
            h = (h ^ first.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) of each occurrence within the documents ids[start:stop]."""
        m, found_at, found = self.m, [], []
        lanes_of = np.maximum(0, -(-(stops - starts - m + 1) // LANE))
        first = np.repeat(starts, lanes_of)
        step = np.arange(lanes_of.sum()) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        at = first + step * LANE  # the first word of the window
        last = np.minimum(at + LANE, np.repeat(stops, lanes_of) - m + 1)  # the lane's windows begin before this
        while len(at):
            end = at + m - 1
            h = self._hash(ids[end - 1] if self.block == 2 else None, ids[end])
            shift = self.shift[h]
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                a, hz = at[zero], h[zero]
                n = (self.start[hz + 1] - self.start[hz]).astype(np.int64)
                which = np.repeat(np.arange(len(a)), n)
                rank = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                pattern = self.order[self.start[hz][which] + rank]
                place = a[which]
                for j in range(m):  # direct comparison, on what is left of the candidates
                    same = ids[place + j] == self.words[self.places[pattern] + j]
                    place, pattern = place[same], pattern[same]
                found_at.append(place)
                found.append(pattern)
            at = at + np.maximum(shift, 1)
            live = at < last
            at, last = at[live], last[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)


class Patterns:
    """All windows of some benchmark items: vocabulary, one searcher for each length, items of a pattern. It is all arrays, to be sent."""

    def __init__(self, items: list[tuple[str, bytes]]):
        vocabulary: dict[bytes, int] = {}
        flat, ends = array("i"), []
        for _, text in items:
            flat.extend([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)])
            ends.append(len(flat))
        ids = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
        stops = np.array(ends, np.int64)
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        size = np.minimum(stops - starts, WINDOW)
        self.names = [name for name, _ in items]
        self.blob, self._vocabulary = b" ".join(vocabulary), None
        self.searchers = []
        for m in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == m)
            n = stops[own] - starts[own] - m + 1
            item = np.repeat(own, n)
            place = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(len(item))
            # equal windows are one pattern: rank by doubling words, so that numbers stay small
            rank = np.zeros(len(place), np.int64)
            for j in range(m):
                rank = np.unique(rank * (len(vocabulary) + 1) + ids[place + j], return_inverse=True)[1]
            order = np.lexsort((item, rank))
            rank, item, place = rank[order], item[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (item[1:] != item[:-1])])
            owner_start = np.searchsorted(rank[new], np.arange(len(first) + 1)).astype(np.int32)
            self.searchers.append((WuManber(ids, place[first], m), owner_start, item[new].astype(np.int32)))

    def __getstate__(self):
        return {**self.__dict__, "_vocabulary": None}

    @property
    def vocabulary(self) -> dict[bytes, int]:
        if self._vocabulary is None:  # once for each worker
            self._vocabulary = {w: k for k, w in enumerate(self.blob.split(b" "), 1)} if self.blob else {}
        return self._vocabulary

    def search(self, docs: list[bytes]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each document its number of words, the positions of the words hit, the items found."""
        get, flat, ends = self.vocabulary.get, [], []
        for text in docs:
            flat += [get(w, 0) for w in words(text)]
            ends.append(len(flat))
        ids = np.array(flat, np.int32)
        stops = np.array(ends, np.int64)
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        cover = np.zeros(len(ids) + 1, np.int32)
        items: list[set[str]] = [set() for _ in docs]
        for searcher, first, owner in self.searchers:
            at, pattern = searcher.find(ids, starts, stops)
            if len(at):
                np.add.at(cover, at, 1)
                np.add.at(cover, at + searcher.m, -1)
                pairs = np.unique(np.stack([np.searchsorted(stops, at, "right"), pattern]), axis=1)
                for d, p in pairs.T.tolist():
                    items[d].update([self.names[x] for x in owner[first[p] : first[p + 1]].tolist()])
        hit = np.cumsum(cover)[:-1] > 0
        return [(b - a, np.flatnonzero(hit[a:b]), x) for a, b, x in zip(starts.tolist(), stops.tolist(), items, strict=True)]


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items as lists of at most about block_bytes of text, read one partition at a time; one empty list if there are none."""
    block, size, any_ = [], 0, False
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").filter("text is not null").toLocalIterator():
        block.append((row.i if row.i is not None else "", row.text.encode()))
        size += len(block[-1][1])
        if size >= block_bytes:
            yield block
            block, size, any_ = [], 0, True
    if block or not any_:
        yield block


COUNTS = "n_words long, n_hit long, n_items long, items_sha256 string"


def contamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated.

    A null text has no words; it and an empty text have n_hit 0 and the digest of no items. Null ids
    stay null; repeated rows are judged one by one. A benchmark item without words (or null) has no
    window; an item with a null id counts under the empty name. An empty benchmark hits nothing.
    Other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    first, blocks = _first(benchmark, block_bytes)
    if blocks is None:
        return _verdict(_scan(spark, docs, first))
    return _verdict(_several(spark, docs, first, blocks)).drop("sha")


def _first(benchmark: DataFrame, block_bytes: int):
    """The first block, and the blocks after it (None if there are none)."""
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    return first, None if second is None else chain([second], blocks)


def _verdict(counts: DataFrame) -> DataFrame:
    return counts.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _scan(spark: SparkSession, docs: DataFrame, items: list) -> DataFrame:
    """doc_id and COUNTS of (doc_id, text)."""
    sent = spark.sparkContext.broadcast(Patterns(items))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        patterns = sent.value
        for batch in batches:
            column = batch.column("text")
            for a, b in runs(column):
                found = patterns.search(list(texts(column.slice(a, b - a))))
                more = [pa.array([f(x) for x in found], t) for f, t in ((lambda x: x[0], pa.int64()), (lambda x: len(x[1]), pa.int64()), (lambda x: len(x[2]), pa.int64()), (lambda x: digest(x[2]), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *more], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    return docs.mapInArrow(scan, f"doc_id {kind}, {COUNTS}")


def _hits(docs: DataFrame, sent, everything: bool) -> DataFrame:
    """(doc_id, sha, n_words, positions of words hit, items) of (doc_id, sha, text); only rows with hits unless everything is asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        patterns = sent.value
        for batch in batches:
            column = batch.column("text")
            for a, b in runs(column):
                found = patterns.search(list(texts(column.slice(a, b - a))))
                part = batch.slice(a, b - a)
                more = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int32())), pa.array([sorted(x[2]) for x in found], pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sha"), *more], ["doc_id", "sha", "n_words", "positions", "items"])
                yield out if everything else out.filter(pa.array([len(x[1]) > 0 for x in found], pa.bool_()))

    return docs.select("doc_id", "sha", "text").mapInArrow(scan, f"doc_id {kind}, sha string, n_words long, positions array<int>, items array<string>")


def _sha() -> Column:
    """Tells texts apart: the SHA-256 of a text, null for none."""
    return F.sha2("text", 256)


def _several(spark: SparkSession, docs: DataFrame, first: list, blocks) -> DataFrame:
    """doc_id, sha and COUNTS: one scan for each block of patterns, whose hits are written; those of a document (equal in id and text) are merged."""
    ws = Workspace(spark, "contamination")
    keyed = docs.withColumn("sha", _sha())
    base, hits = None, None
    for k, items in enumerate(chain([first], blocks)):
        sent = spark.sparkContext.broadcast(Patterns(items))
        found = ws.save(_hits(keyed, sent, k == 0), f"block-{k}")
        sent.destroy()
        base = found if base is None else base
        own = found.filter(F.size("positions") > 0).groupBy("doc_id", "sha").agg(F.first("positions").alias("positions"), F.first("items").alias("items"))  # equal rows have equal hits
        hits = own if hits is None else hits.union(own)
    merged = hits.groupBy(F.col("doc_id").alias("d"), F.col("sha").alias("s")).agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("p"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
    return base.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("sha").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "sha", "n_words", F.size(F.coalesce("p", F.array().cast("array<int>"))).cast("long").alias("n_hit"), F.size(F.coalesce("i", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.coalesce("i", F.array().cast("array<string>"))), ","), 256).alias("items_sha256"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table against all windows of the whole benchmark table."""
    return contamination(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def clean(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns, in one scan if the patterns fit one block."""
    first, blocks = _first(benchmark, block_bytes)
    if blocks is not None:
        bad = _verdict(_several(spark, documents.select("doc_id", "text"), first, blocks)).filter("contaminated")
        free = lambda x: x if x not in documents.columns else free(x + "_")
        bad_id, bad_sha = free("__bad"), free("__sha")
        bad = bad.select(F.col("doc_id").alias(bad_id), F.col("sha").alias(bad_sha)).distinct()
        return documents.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (_sha() == F.col(bad_sha)), "left_anti")
    sent = spark.sparkContext.broadcast(Patterns(first))
    at = documents.columns.index("text")

    def scan(batches):
        patterns = sent.value
        for batch in batches:
            for a, b in runs(batch.column(at)):
                found = patterns.search(list(texts(batch.column(at).slice(a, b - a))))
                keep = pa.array([not (len(h) > 0 and 20 * len(h) >= n) for n, h, _ in found], pa.bool_())
                yield batch.slice(a, b - a).filter(keep)

    return documents.mapInArrow(scan, documents.schema)


ORACLE_SQL = r"""
WITH dw AS (SELECT rowid AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(13, len(w)) AS m, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM pat),
win AS (SELECT rid, m, k, array_to_string(w[k : k + m - 1], ' ') AS p
        FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw, lens WHERE len(w) >= m)),
occ AS (SELECT win.rid, win.k, win.m, pat.item FROM win JOIN pat ON win.m = pat.m AND win.p = pat.p),
hits AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(k, k + m)) AS x FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)
"""
