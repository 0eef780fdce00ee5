"""WARC archives with an externally merged capture index.

Writing: a task writes its pages as WARC 1.1 records (one gzip member each) into files of about
``FILE_BYTES``, and for its captures an index run: lines sorted by URL key, time and place. A page
whose payload of at least ``LEAST`` bytes also belongs to a smaller page_id becomes a revisit
record, which holds the HTTP head and the payload's digest but no payload.

Merging: the sorted runs are merged k ways by a loser tree. Runs beyond ``FAN_IN`` are first merged
in groups, level by level; a merged run is a row of files. Each merge is dealt by ranges of whole index
lines, so that no task gets much more than ``RANGE_LINES`` of them and captures of one much-visited URL
can be split too; a merge task finds its range in each run by a binary search of the run's fence lines
and holds one line and one read buffer for each run. The result is the capture history of each URL key,
in global order over the numbered merged files.

The driver holds the runs' names, the ranges of a level (at most ``MOST_TASKS``) and at most
``MOST_SAMPLES`` lines of all runs together, which the ranges are cut by.

Files get a name of their own for each attempt; the tables of files, written through Spark's commit
protocol, list those of the attempts that counted. Lost executors so leave unlisted files at most.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._common import Workspace, read, runs, texts

LEAST = 100
FILE_BYTES = 256 << 20
RUN_LINES = 500_000
FENCE = 512
FAN_IN = 128
RANGE_LINES = 200_000
SAMPLES = 64
MOST_SAMPLES = 200_000
MOST_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URI = "urn:lodestar:page:"


def url_key(url: str | None) -> str:
    """A sortable key: host labels reversed without www, then path and ordered query; "-" without a url."""
    if not url or not url.strip():
        return "-"
    m = re.match(r"(?:([a-z][a-z0-9+.-]*):)?(?://(?:[^/?#@]*@)?([^/?#]*))?([^?#]*)(?:\?([^#]*))?", url.strip(), re.I | re.S)
    host = re.sub(r":(?:80|443)?\Z", "", (m[2] or "").lower())
    host = re.sub(r"\Awww\d*\.", "", host)
    query = "&".join(sorted((m[4] or "").lower().split("&"))) if m[4] else ""
    key = ",".join(reversed(host.split("."))) + ")" + ((m[3] or "/").lower().rstrip("/") or "/") + (f"?{query}" if query else "")
    return _printable(key)


def _printable(text: str) -> str:
    """Without white space and control characters, which are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, seconds: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record: a revisit of page ``first`` if that is given, else a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{_URI}{'' if page_id is None else page_id}>", f"WARC-Date: {seconds}",
        *([f"WARC-Target-URI: {_printable(url)}"] if url else []), f"WARC-Payload-Digest: sha256:{digest}", *([f"WARC-Refers-To: <{_URI}{first}>", f"WARC-Profile: {PROFILE}"] if first is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, head, block) of each record of an archive with one gzip member for each; one record is held."""
    data, at = b"", 0
    while True:
        unzip, pieces, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not data:
                data = stream.read(1 << 20)
                if not data:
                    if used:
                        raise ValueError("the archive ends within a record")
                    return
            pieces.append(unzip.decompress(data))
            used += len(data) - len(unzip.unused_data)
            data = unzip.unused_data
        head, _, rest = b"".join(pieces).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        yield at, used, fields, rest[: int(fields["content-length"])]
        at += used


class LoserTree:
    """k sorted iterators of bytes merged into one: an inner node holds the loser of its match, the winner goes up."""

    def __init__(self, sources: list[Iterator[bytes]]):
        self.sources, self.k = sources, max(1, len(sources))
        self.head: list[bytes | None] = [next(s, None) for s in sources] or [None]
        self.loser = [-1] * self.k
        for leaf in range(self.k - 1, -1, -1):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether leaf a goes before leaf b; an ended source goes last, equal lines in order of source."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _play(self, leaf: int) -> None:
        node = (leaf + self.k) // 2
        while node > 0:
            if self.loser[node] < 0:  # the first to come waits for its match
                self.loser[node] = leaf
                return
            if self._less(self.loser[node], leaf):
                self.loser[node], leaf = leaf, self.loser[node]
            node //= 2
        self.loser[0] = leaf  # the winner of all

    def __iter__(self) -> Iterator[bytes]:
        while (line := self.head[winner := self.loser[0]]) is not None:
            yield line
            self.head[winner] = next(self.sources[winner], None)
            leaf, node = winner, (winner + self.k) // 2
            while node > 0:
                if self._less(self.loser[node], leaf):
                    self.loser[node], leaf = leaf, self.loser[node]
                node //= 2
            self.loser[0] = leaf


class RunWriter:
    """A sorted run: the lines, and every FENCE-th line with its offset in a second file."""

    def __init__(self, folder: str, name: str, fence: int = FENCE):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{name}-{uuid.uuid4().hex[:12]}"
        self.out = self.fs.open_output_stream(f"{root}/{self.name}.cdxj")
        self.index = self.fs.open_output_stream(f"{root}/{self.name}.fence")
        self.lines = self.at = 0
        self.sample: list[bytes] = []
        self.every = self.fence = fence

    def add(self, line: bytes) -> None:
        if self.lines % self.fence == 0:
            self.index.write(b"%d %s\n" % (self.at, line))
        if self.lines % self.every == 0:
            self.sample.append(line)
            if len(self.sample) >= 2 * SAMPLES:  # evenly spaced lines, of which no more are kept
                self.sample, self.every = self.sample[::2], 2 * self.every
        self.out.write(line + b"\n")
        self.at += len(line) + 1
        self.lines += 1

    def close(self) -> dict:
        self.out.close()
        self.index.close()
        return {"name": self.name, "lines": self.lines, "sample": self.sample}


def run_lines(folder: str, name: str, low: bytes = b"", high: bytes | None = None) -> Iterator[bytes]:
    """The lines of a run from low to below high, starting at the last fence before."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    at = 0
    if low:
        with fs.open_input_file(f"{root}/{name}.fence") as f:
            at = _fence_before(f, low)
    with fs.open_input_file(f"{root}/{name}.cdxj") as f:
        f.seek(at)
        for line in _lines(f, 1 << 16):
            if high is not None and line >= high:
                return
            if line >= low:
                yield line


def _fence_before(f, low: bytes) -> int:
    """The offset of the last fence line that is below ``low``, by binary search; 0 if none is."""

    def line_at(place: int) -> bytes:
        f.seek(place)
        out = b""
        while b"\n" not in out and (data := f.read(1 << 10)):
            out += data
        return out.partition(b"\n")[0]

    first, end, found = 0, f.size(), 0
    while first < end:  # both are beginnings of lines, or the end
        middle = (first + end) // 2
        start = middle + len(line_at(middle)) + 1 if middle > first else first
        start = start if start < end else first
        line = line_at(start)
        offset, _, text = line.partition(b" ")
        if text < low:
            first, found = start + len(line) + 1, int(offset)
        else:
            end = start
    return found


def _lines(f, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while data := f.read(size):
        *lines, rest = (rest + data).split(b"\n")
        yield from lines


_RUNS = "name string, lines long, sample array<binary>"


def _run_batch(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, pa.schema([("name", pa.string()), ("lines", pa.int64()), ("sample", pa.list_(pa.binary()))]))


def _thin(sample: list, most: int) -> list[bytes]:
    """At most ``most`` lines, evenly spaced."""
    return [bytes(x) for x in sample[:: max(1, -(-len(sample) // max(1, most)))]]


def write(ws: Workspace, pages: DataFrame, seconds: Column, run_lines: int = RUN_LINES, fence: int = FENCE) -> tuple[DataFrame, list[dict]]:
    """Write archives and index runs; returns the table (file, records) and the runs.

    ``seconds``: the capture time of a row in seconds since 1970.
    """
    folder = ws.path("archive")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), seconds.cast("long").alias("seconds"), F.sha2(payload, 256).alias("digest"))
    sizes = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= LEAST)
    copies = ws.save(sizes.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first"), "copies")
    joined = rows.join(copies, "digest", "left").select("page_id", "url", "html", "seconds", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("first"))

    def scan(batches):
        from datetime import UTC, datetime

        from pyspark import TaskContext

        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        out = name = None
        at = count = 0
        lines: list[bytes] = []
        done: list[dict] = []

        def close_file():
            out.close()
            done.append({"kind": "file", "name": name, "n": count, "sample": None})

        def close_run():
            run = RunWriter(folder, f"run-{part:06d}", fence)
            for line in sorted(lines):
                run.add(line)
            found = run.close()
            done.append({"kind": "run", "name": found["name"], "n": found["lines"], "sample": found["sample"]})
            lines.clear()

        for batch in batches:
            for a, b in runs(batch.column("html")):
                piece = batch.slice(a, b - a)
                columns = [piece.column(c).to_pylist() for c in ("page_id", "url", "seconds", "digest", "first")]
                for page_id, url, when, digest, first, raw in zip(*columns, texts(piece.column("html")), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            close_file()
                        name = f"warc-{part:06d}-{uuid.uuid4().hex[:12]}.warc.gz"
                        out, at, count = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    time = datetime.fromtimestamp(when or 0, UTC)
                    zipper = zlib.compressobj(3, wbits=31)
                    data = zipper.compress(record(page_id, url, time.strftime("%Y-%m-%dT%H:%M:%SZ"), raw, digest, first)) + zipper.flush()
                    entry = {"file": name, "offset": at, "length": len(data), "digest": f"sha256:{digest}", "type": "response" if first is None else "revisit"}
                    lines.append(f"{url_key(url)} {time:%Y%m%d%H%M%S} {json.dumps(entry)}".encode("utf-8", "replace"))
                    out.write(data)
                    at += len(data)
                    count += 1
                    if len(lines) >= run_lines:
                        close_run()
        if out is not None:
            close_file()
        if lines:
            close_run()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("kind", pa.string()), ("name", pa.string()), ("n", pa.int64()), ("sample", pa.list_(pa.binary()))]))

    made = ws.save(joined.mapInArrow(scan, "kind string, name string, n long, sample array<binary>"), "made")
    own = made.filter("kind = 'run'")
    most = MOST_SAMPLES // max(1, own.count())
    found = [{"name": r.name, "lines": r.n, "sample": _thin(r.sample, most)} for r in own.orderBy("name").toLocalIterator()]
    return made.filter("kind = 'file'").select(F.col("name").alias("file"), F.col("n").alias("records")), found


def merge(ws: Workspace, made: list[dict], range_lines: int = RANGE_LINES, fan_in: int = FAN_IN, fence: int = FENCE) -> list[dict]:
    """Merge the runs into files in global order; returns them in that order, with their numbers of lines."""
    spark, folder, level = ws.spark, ws.path("archive"), 0

    def ranges(group: list[dict], each: float) -> list[tuple[bytes, bytes | None]]:
        """Ranges of about ``each`` lines of some runs, by their sample lines."""
        weighed = sorted((line, r["lines"] / max(1, len(r["sample"]))) for r in group for line in r["sample"])
        cuts, held = [], 0.0
        for line, weight in weighed:
            if held >= each and (not cuts or line > cuts[-1]):
                cuts.append(line)
                held = 0.0
            held += weight
        return list(zip([b"", *cuts], [*cuts, None], strict=True))

    def merged(groups: list[list[list[tuple[str, bytes]]]], tasks: list[tuple[int, bytes, bytes | None]], name: str) -> list[dict]:
        """The files made of the tasks (group, from, to), in their order. A run is its files, each with the smallest line that it may hold."""
        sent = spark.sparkContext.broadcast((groups, tasks))

        def lines(run, low, high):
            for (file, first), (_, following) in zip(run, [*run[1:], ("", None)], strict=True):
                if (high is None or first < high) and (following is None or following > low):
                    yield from run_lines(folder, file, low, high)

        def scan(batches):
            groups, tasks = sent.value
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    group, low, high = tasks[k]
                    run = RunWriter(folder, f"{name}-{k:06d}", fence)
                    for line in LoserTree([lines(x, low, high) for x in groups[group]]):
                        run.add(line)
                    yield _run_batch([run.close()])

        done = ws.save(spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(scan, _RUNS), name)
        return [{"name": r.name, "lines": r.lines, "sample": _thin(r.sample, MOST_SAMPLES // len(tasks))} for r in done.orderBy("name").toLocalIterator()]

    if not made:
        return []
    runs_ = [{"files": [(r["name"], b"")], "lines": r["lines"], "sample": r["sample"]} for r in made]
    each = max(range_lines, sum(r["lines"] for r in runs_) / MOST_TASKS)
    while True:
        level += 1
        groups = [runs_[a : a + fan_in] for a in range(0, len(runs_), fan_in)]
        tasks = [(g, *x) for g, group in enumerate(groups) for x in ranges(group, each)]
        done = merged([[r["files"] for r in group] for group in groups], tasks, f"level-{level}")
        if len(groups) == 1:
            return done
        runs_ = []
        for g in range(len(groups)):
            own = [(r, t) for r, t in zip(done, tasks, strict=True) if t[0] == g]
            runs_.append({"files": [(r["name"], t[1]) for r, t in own], "lines": sum(r["lines"] for r, _ in own), "sample": [x for r, _ in own for x in r["sample"]]})


def read_archives(ws: Workspace, files: DataFrame) -> DataFrame:
    """(file, offset, page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, read from the archives.

    The digest and length of a response come from its payload; a record whose payload does not match
    its own digest is an error. Those of a revisit come from its head, as its payload is elsewhere.
    """
    folder = ws.path("archive")

    def scan(batches):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        page = lambda x: int(x.strip("<>").removeprefix(_URI)) if x and x.strip("<>") != _URI else None
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for at, _, head, block in records(f):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = head["warc-payload-digest"].removeprefix("sha256:")
                        size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
                        if head["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != said or len(payload) != size):
                            raise ValueError(f"{name} at {at}: the payload does not match its digest")
                        rows.append({"file": name, "offset": at, "page_id": page(head["warc-record-id"]), "payload_bytes": size, "payload_digest": said, "record_type": head["warc-type"], "refers_to": page(head.get("warc-refers-to"))})
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, types)

    kinds = [("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    types = pa.schema(kinds)
    n = max(1, min(10_000, files.count()))
    return files.select("file").repartition(n, "file").mapInArrow(scan, ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in kinds))


def read_index(ws: Workspace, merged: list[dict]) -> DataFrame:
    """(url_key, captured, file, offset, capture) in global order: capture numbers all captures from 0."""
    folder, starts, at = ws.path("archive"), [], 0
    for r in merged:
        starts.append((r["name"], at))
        at += r["lines"]
    sent = ws.spark.sparkContext.broadcast(starts)

    def scan(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                name, number = sent.value[k]
                rows = []
                for line in run_lines(folder, name):
                    key, time, entry = line.decode("utf-8", "replace").split(" ", 2)
                    entry = json.loads(entry)
                    rows.append({"url_key": key, "captured": time, "file": entry["file"], "offset": entry["offset"], "capture": number})
                    number += 1
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, types)

    types = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("capture", pa.int64())])
    return ws.spark.range(0, len(starts), 1, max(1, len(starts))).mapInArrow(scan, "url_key string, captured string, file string, offset long, capture long")


def by_page_id() -> Column:
    """A capture time for tables that have none: a second for each page_id from the start of 2024."""
    return F.lit(1_704_067_200) + F.coalesce(F.pmod(F.col("page_id"), F.lit(1_000_000_000)), F.lit(0))


def round_trip(spark: SparkSession, pages: DataFrame, seconds: Column | None = None, **merge_options) -> DataFrame:
    """Write pages, merge the index, read back along it: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, capture.

    A null html is an empty payload. Rows that share the smallest page_id of a payload are all
    responses; a null page_id refers to the smallest one that is not null, and is a response where
    all are null. A null or empty url has the key "-". An empty table writes nothing and gives no
    rows. Other columns are ignored.
    """
    ws = Workspace(spark, "warc")
    files, made = write(ws, pages, by_page_id() if seconds is None else seconds)
    index = read_index(ws, merge(ws, made, **merge_options))
    # the planner takes tables made from a range of file numbers for small ones: no broadcast
    return index.join(read_archives(ws, files).hint("merge"), ["file", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages table through archives and back."""
    return round_trip(spark, read(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, trim(coalesce(url, ''), E' \t\n\r\x0b\x0c') AS u FROM pages),
d AS (SELECT page_id, u, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha256(h) AS s FROM p),
f AS (SELECT s, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY s),
parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)?$', ''), '^www[0-9]*\.', '') AS host,
  regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query FROM d),
keyed AS (SELECT *, CASE WHEN u = '' THEN '-' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
  CASE WHEN rtrim(lower(path), '/') = '' THEN '/' ELSE rtrim(lower(path), '/') END ||
  CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(lower(query), '&')), '&') END END AS url_key,
  strftime(make_timestamp((1704067200 + coalesce(((page_id % 1000000000) + 1000000000) % 1000000000, 0)) * 1000000), '%Y%m%d%H%M%S') AS captured FROM parts)
SELECT page_id, n AS payload_bytes, k.s AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS capture
FROM keyed k LEFT JOIN f ON k.s = f.s
"""
