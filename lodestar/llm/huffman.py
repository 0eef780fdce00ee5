"""Token-id files: canonical length-limited Huffman codes, decoded by table in independent blocks.

The ids of all documents, in ascending order of doc_id, go to a few files, one for each range of
doc_id. Code lengths come from the counts of all ids by package-merge, so that no code is longer
than ``LIMIT`` bits; codes are canonical, so a file only holds the lengths. Within a file the ids
form blocks of ``BLOCK`` ids; a checkpoint holds each block's bit offset, so blocks are decoded
independently, and here side by side: one table lookup decodes the next id of every block.

Steps: the ids are made once and written to a table (uint16 where the vocabulary allows it); the
counts are summed from one partial count per task; the table is dealt by range of doc_id, so that
each file has about ``FILE_BYTES`` of ids whatever the lengths of documents (the bounds come from a
sample of rows by their bytes; rows that share an id at a bound are dealt over all files that it
bounds), and sorted within partitions, and each task streams its documents into its file. Memory is
bounded by the Arrow batch and ``PIECE`` ids. A file's name is its attempt's own, and only the files
of the attempts that counted are listed, so a task may run again.

File: magic, LIMIT, code lengths (uint8 for each id), then segments. A segment is a header of
uint64 (documents, ids, payload bytes), each document's doc_id, null flag and number of ids, the
checkpoints, the payload. A document that is longer than a segment goes on in the next one.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._common import Workspace, read, runs, texts
from lodestar.llm.tokens import PieceMemo, default_tokenizer

LIMIT = 20
BLOCK = 256
PIECE = 1 << 20
FILE_BYTES = 8 << 20
MOST_FILES = 100_000
_NULL = -(2**63)
MAGIC = b"LDHUF1\0\0"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for the ids that occur (0 for others), by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    levels, merged = [], np.zeros(0)
    for _ in range(limit):  # each level merges the single ids with the pairs of the level before
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        levels.append(order < len(weight))
    take = 2 * len(used) - 2
    depth = np.zeros(len(used), np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[used] = depth
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: by length, then by id."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    if len(order):
        n = lengths[order].astype(np.int64)
        top = np.concatenate([[0], np.cumsum(1 << (int(n.max()) - n))])[:-1]  # as fractions of 2**max
        out[order] = top >> (int(n.max()) - n)
    return out


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), codes(lengths)
        self.width = int(lengths.max(initial=1))

    def table(self) -> np.ndarray:
        """For each value of the next ``width`` bits the id and its length, as id * 32 + length."""
        if not hasattr(self, "_table"):
            used = np.flatnonzero(self.lengths)
            order = used[np.argsort(self.lengths[used], kind="stable")]
            n = self.lengths[order]
            entries = np.repeat(order * 32 + n, 1 << (self.width - n))
            self._table = np.zeros(1 << self.width, np.uint32)
            self._table[: len(entries)] = entries
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit offset of each block, payload as big-endian 32-bit words)."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = ends - n
        shifted = self.codes[ids] << (np.uint64(64) - n.astype(np.uint64) - (at & 31).astype(np.uint64))
        word = at >> 5
        size = (int(ends[-1]) + 31 >> 5) + 3 if len(ids) else 3  # two spare words for the decoder
        high = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), size)
        low = np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        return at[::BLOCK].astype(np.uint64), (high + low).astype(np.uint64).astype(">u4")

    def decode(self, checkpoints: np.ndarray, payload: np.ndarray, total: int) -> np.ndarray:
        """All ids of a segment; its blocks are decoded side by side."""
        table, shift = self.table(), np.uint64(64 - self.width)
        words = payload.astype(np.uint64)
        pair = (words[:-1] << np.uint64(32)) | words[1:]
        blocks = len(checkpoints)
        out = np.zeros((BLOCK, blocks), np.uint32)
        at = checkpoints.astype(np.int64)
        last = total - (blocks - 1) * BLOCK
        for k in range(min(BLOCK, total)):
            if k == last:
                at = at[:-1]
            entry = table[((pair[at >> 5] << (at & 31).astype(np.uint64)) >> shift).astype(np.int64)]
            out[k, : len(at)] = entry >> 5
            at = at + (entry & 31)
        return out.T.reshape(-1)[:total]


def _open(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


def _segment(codec: Codec, docs: list[tuple], ids: np.ndarray) -> bytes:
    checkpoints, payload = codec.encode(ids)
    head = struct.pack("<QQQ", len(docs), len(ids), payload.nbytes)
    key = np.array([d if d is not None else 0 for d, _ in docs], np.int64)
    null = np.array([d is None for d, _ in docs], np.uint8)
    return head + key.tobytes() + null.tobytes() + np.array([n for _, n in docs], np.int64).tobytes() + checkpoints.tobytes() + payload.tobytes()


def id_type(tokenizer: str) -> str:
    """The smallest little-endian integers that hold the vocabulary's ids."""
    return "<u2" if PieceMemo.shared(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def token_table(documents: DataFrame, tokenizer: str, end: int | None) -> DataFrame:
    """(doc_id, ids) with ids as integers of ``id_type``; a null text is empty."""
    kind = id_type(tokenizer)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(batches):
        memo = PieceMemo.shared(tokenizer)
        for batch in batches:
            for a, b in runs(batch.column("text")):
                ids, at = memo.ids(list(texts(batch.column("text").slice(a, b - a))), end)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((at * np.dtype(kind).itemsize).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())]).cast(pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(scan, "doc_id long, ids binary")


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs, over all rows; the size is that of the vocabulary."""

    def scan(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for a, b in runs(batch.column("ids"), 16 << 20):
                ids = np.frombuffer(b"".join(texts(batch.column("ids").slice(a, b - a))), kind)
                more = np.bincount(ids)
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    sums = tokens.select("ids").mapInArrow(scan, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in sums), default=0) + 1, np.int64)
    for r in sums:
        out[r.id] = r.n
    return out


def bounds(tokens: DataFrame, file_bytes: int) -> np.ndarray:
    """The doc_ids (null as the smallest) that cut (doc_id, ids, place) into files of about equal bytes, in order; as many as files less one."""
    total = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    files = max(1, min(MOST_FILES, -(-total // file_bytes)))
    if files == 1:
        return np.zeros(0, np.int64)
    unit = max(1.0, total / (files * 1000))  # a row is taken about once for each unit of its bytes
    chance = F.pmod(F.xxhash64("place"), F.lit(1 << 20)) / float(1 << 20)
    sample = tokens.select(F.coalesce("doc_id", F.lit(_NULL)).alias("id"), F.floor(F.octet_length("ids") / unit + chance).cast("int").alias("n")).filter("n > 0").select("id", F.explode(F.sequence(F.lit(1), "n")))
    found = sample.agg(F.percentile_approx("id", [k / files for k in range(1, files)], max(10_000, 10 * files)).alias("x")).first().x
    return np.array(found or [], np.int64)


def deal(tokens: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(doc_id, ids, place, file): the file by the cuts before the doc_id; rows with a cut's own id go to any file that it bounds, by hash of place."""
    sent = tokens.sparkSession.sparkContext.broadcast(cuts)

    def scan(batches):
        cuts = sent.value
        for batch in batches:
            own = batch.column("doc_id").fill_null(_NULL).to_numpy()
            low, high = np.searchsorted(cuts, own, "left"), np.searchsorted(cuts, own, "right")
            mix = batch.column("place").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((low + (mix % (high - low + 1).astype(np.uint64)).astype(np.int64)).astype(np.int32))], ["doc_id", "ids", "place", "file"])

    return tokens.mapInArrow(scan, "doc_id long, ids binary, place long, file int")


def write_ids(ws: Workspace, tokens: DataFrame, kind: str, file_bytes: int = FILE_BYTES, piece: int = PIECE) -> list[str]:
    """Write (doc_id, ids, place) to files in ascending order of doc_id, nulls first, then place; returns the files in that order.

    place: a number of its own for each row of a written table.
    """
    lengths = code_lengths(id_counts(tokens, kind))
    sent = ws.spark.sparkContext.broadcast(lengths)
    folder = ws.path("files")
    cuts = bounds(tokens, file_bytes)
    ordered = deal(tokens.select("doc_id", "ids", "place"), cuts).repartitionById(len(cuts) + 1, "file").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place")

    def write(batches):
        from pyspark import TaskContext

        codec = Codec(sent.value)
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"ids-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.huf"  # of this attempt alone
        docs, held, size, total = [], [], 0, 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(MAGIC + struct.pack("<II", LIMIT, len(sent.value)) + sent.value.tobytes())
            for batch in batches:
                keys = batch.column("doc_id").to_pylist()
                for key, raw in zip(keys, texts(batch.column("ids")), strict=True):
                    ids, total = np.frombuffer(raw, kind), total + 1
                    while size + len(ids) > piece:  # the segment is full; a long document goes on in the next one
                        if room := piece - size:
                            docs.append((key, -room))
                            held.append(ids[:room])
                            ids = ids[room:]
                        out.write(_segment(codec, docs, np.concatenate(held)))
                        docs, held, size = [], [], 0
                    docs.append((key, len(ids)))
                    held.append(ids)
                    size += len(ids)
            if docs:
                out.write(_segment(codec, docs, np.concatenate(held)))
        yield pa.RecordBatch.from_arrays([pa.array([name] if total else [], pa.string())], ["name"])

    return [f"{folder}/{r.name}" for r in sorted(ordered.mapInArrow(write, "name string").collect())]


def read_file(uri: str):
    """(doc_id, ids) of each document of a file, in order; no more than a segment and a document are held."""
    fs, path = _open(uri)
    with fs.open_input_stream(path) as f:
        if f.read(8) != MAGIC:
            raise ValueError(f"{uri}: not a file of token ids")
        _, n = struct.unpack("<II", f.read(8))
        codec = Codec(np.frombuffer(f.read(n), np.uint8))
        open_piece: list[np.ndarray] = []
        while head := f.read(24):
            docs, total, size = struct.unpack("<QQQ", head)
            key = np.frombuffer(f.read(8 * docs), np.int64)
            null = np.frombuffer(f.read(docs), np.uint8)
            count = np.frombuffer(f.read(8 * docs), np.int64)
            checkpoints = np.frombuffer(f.read(8 * (-(-total // BLOCK))), np.uint64)
            ids = codec.decode(checkpoints, np.frombuffer(f.read(size), ">u4"), total)
            ends = np.cumsum(np.abs(count))
            for d in range(docs):
                own = ids[ends[d] - abs(count[d]) : ends[d]]
                if count[d] < 0:  # it goes on in the next segment
                    open_piece.append(own)
                    continue
                yield (None if null[d] else int(key[d])), np.concatenate([*open_piece, own]) if open_piece else own
                open_piece = []


def read_ids(spark: SparkSession, files: list[str]) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it within its file), n_tokens, ids_crc32, file (its place)."""
    sent = spark.sparkContext.broadcast(files)

    def scan(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                at, rows = 0, []
                for key, ids in read_file(sent.value[k]):
                    rows.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), k))
                    at += len(ids)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], types)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], types)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "file"]
    types = pa.schema([(n, pa.int32() if n == "file" else pa.int64()) for n in names])
    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long, file int")


def round_trip(spark: SparkSession, documents: DataFrame, tokenizer: str, end: int | None = 1) -> DataFrame:
    """Write the ids of all documents to files and read them back: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before this one. A null or empty text has only the end id.
    Null ids come first and stay null; rows with equal ids follow each other. An empty table writes no
    file and gives no rows. Other columns are ignored.
    """
    ws = Workspace(spark, "token-ids")
    files = write_ids(ws, ws.save(token_table(documents, tokenizer, end).withColumn("place", F.monotonically_increasing_id()), "tokens"), id_type(tokenizer))
    ws.drop("tokens")
    back = ws.save(read_ids(spark, files), "read")
    before, at = [], 0
    for r in sorted(back.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()):
        before.append((r.file, at))
        at += r.n
    offsets = spark.createDataFrame(before, "file int, before long")
    return back.join(F.broadcast(offsets), "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table through files of token ids and back."""
    return round_trip(spark, read(spark, sf_dir, "documents"), default_tokenizer())
