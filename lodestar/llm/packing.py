"""Best-fit packing planned over the histogram of piece lengths.

Documents become token pieces of at most ``LENGTH`` ids; only longer documents are cut. The plan
works on counts, not on pieces: from the longest length down, all pieces of a length go at once to
the sequences whose room fits best (the smallest room that is enough), then to new sequences. A
step of the plan gives a run of equal slots: pieces number a to b of this length go to sequences
s, s + 1, ... at one offset. The plan depends on the lengths alone, so it is made on the driver
from at most ``LENGTH`` counts, however many documents there are.

Pieces take slots by joining on (length, rank within length). The rank needs no task that sees all
pieces of a length: a length has a salt for each ``SALT_ROWS`` of its pieces, pieces are dealt by
(length, salt) and numbered within, and the numbers start from the sum of the counts of the salts
before, which are summed in groups of ``GROUP`` salts and then over the groups. The salt is a hash of
a piece's place in the written table, so that equal rows have different ones. Pieces of full length,
the commonest, need neither plan nor rank: each is a sequence, numbered by its place. Text is read
once; only lengths are shuffled.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm._common import Workspace, read, runs, schema, texts
from lodestar.llm.tokens import PieceMemo, default_tokenizer

LENGTH = 4096
SALT_ROWS = 200
GROUP = 1000


def plan(counts: dict[int, int], room: int = LENGTH) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit, longest first, over counts. Returns slots (length, first rank, first sequence, offset) and the number of sequences.

    The slots of a length are in order of first rank; each holds until the next one of its length,
    its pieces taking one sequence each. Sequences of equal room are runs of consecutive numbers.
    The result is that of placing the pieces one by one, each where the least room is left.
    """
    runs_of: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first, count)
    some = np.zeros(room + 2, bool)  # rooms that have runs
    slots: list[tuple[int, int, int, int]] = []
    sequences = 0

    def put(free: int, first: int, count: int) -> None:
        if free > 0 and count > 0:
            runs_of[free].append((first, count))
            some[free] = True

    for length in sorted((n for n in counts if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            free = length + int(np.argmax(some[length:]))
            if some[free]:
                first, count = runs_of[free].pop()
                some[free] = bool(runs_of[free])
            else:
                free = room
                first, count = sequences, -(-left // (room // length))
                sequences += count
            each = free // length
            full = min(count, left // each)  # sequences that take all they can, then one that takes the rest
            rest = min(left - full * each, each) if full < count else 0
            if full:
                slots += [(length, rank + k * full, first, room - free + k * length) for k in range(each)]
                put(free - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            slots += [(length, rank + k, first + full, room - free + k * length) for k in range(rest)]
            if rest:
                put(free - rest * length, first + full, 1)
            rank, left = rank + rest, left - rest
            put(free, first + full + (rest > 0), count - full - (rest > 0))
    return slots, sequences


def pieces(documents: DataFrame, tokenizer: str, room: int = LENGTH, end: int | None = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pieces of each row's ids: keep, piece, start, length, ids_crc32. Without an end id a text without ids has no piece."""
    rows = documents.select(*keep, F.col("text").alias("__text"))
    at = len(keep)

    def scan(batches):
        memo = PieceMemo.shared(tokenizer)
        for batch in batches:
            for a, b in runs(batch.column(at)):
                ids, ends = memo.ids(list(texts(batch.column(at).slice(a, b - a))), end)
                raw = memoryview(ids.astype("<u4")).cast("B")
                row, piece, start, length, crc = [], [], [], [], []
                for k, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                    for i, p in enumerate(range(x, y, room)):
                        q = min(p + room, y)
                        row.append(k)
                        piece.append(i)
                        start.append(p - x)
                        length.append(q - p)
                        crc.append(zlib.crc32(raw[4 * p : 4 * q]))
                own = batch.slice(a, b - a).take(pa.array(row, pa.int64())).columns[:at]
                yield pa.RecordBatch.from_arrays([*own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], [*keep, "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(scan, schema(rows, list(keep), "piece int, start long, length long, ids_crc32 long"))


def assign(ws: Workspace, table: DataFrame, room: int = LENGTH, salt_rows: int = SALT_ROWS, place: str = "__place", group: int = GROUP) -> DataFrame:
    """Give each piece its sequence_id and offset. table: written, with length (at most room) and a number of its own for each row, ``place``."""
    names = [c for c in table.columns if c != place]
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `room` rows
    counts.pop(room, None)
    slots, sequences = plan(counts, room)
    whole = table.filter(F.col("length") == room).select(*names, (F.lit(sequences) + F.col(place)).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salts = ws.spark.createDataFrame([(n, -(-c // salt_rows)) for n, c in counts.items()], "__length long, __salts long")
    salted = table.join(F.broadcast(salts), F.col("length") == F.col("__length")).select(*names, place, F.pmod(F.xxhash64(place), F.col("__salts")).alias("__salt"))
    counted = ws.save(salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")).withColumn("__group", F.expr(f"__salt div {group}")), "counts")
    key = np.array([n << 44 | r for n, r, _, _ in slots], np.int64)
    order = np.argsort(key)
    sent = ws.spark.sparkContext.broadcast((key[order], np.array([s for _, _, s, _ in slots], np.int64)[order], np.array([o for *_, o in slots], np.int64)[order]))
    above = lambda keys, by: F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counted.groupBy("length", "__group").agg(F.sum("__n").alias("__n")).select("length", "__group", above(["length"], "__group").alias("__first"))
    base = counted.withColumn("__own", above(["length", "__group"], "__salt")).join(groups, ["length", "__group"]).select("length", "__salt", (F.col("__first") + F.col("__own")).alias("__base"))
    number = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(place))
    ranked = salted.withColumn("__rank", number.cast("long") - 1).join(base, ["length", "__salt"]).select(*names, (F.col("__base") + F.col("__rank")).alias("__rank"))

    def put(batches):
        keys, first, offset = sent.value
        for batch in batches:
            want = (batch.column("length").to_numpy().astype(np.int64) << 44) | batch.column("__rank").to_numpy()
            slot = np.searchsorted(keys, want, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first[slot] + want - keys[slot]), pa.array(offset[slot])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(put, schema(table, names, "sequence_id long, offset long")).union(whole)


def pack(spark: SparkSession, documents: DataFrame, tokenizer: str, room: int = LENGTH, end: int | None = 1) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has only the end id. Null ids stay null; repeated rows each get slots of their
    own. An empty table gives no rows. Other columns are ignored.
    """
    ws = Workspace(spark, "packing")
    return assign(ws, ws.save(pieces(documents, tokenizer, room, end).withColumn("__place", F.monotonically_increasing_id()), "pieces"), room)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the whole documents table."""
    return pack(spark, read(spark, sf_dir, "documents"), default_tokenizer())
