import gzip
import hashlib
import heapq
import random

import pytest
from helpers import real
from pyspark.sql import functions as F

from lodestar.llm import warc as W
from lodestar.llm._common import Workspace


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    for _ in range(30):
        lists = [sorted(b"%d" % rng.randint(0, 30) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(W.LoserTree([iter(x) for x in lists])) == list(heapq.merge(*lists))


def test_url_key():
    assert W.url_key("HTTP://www.Example.COM:80/A/b/?z=1&a=2#top") == "com,example)/a/b?a=2&z=1"
    assert W.url_key("https://example.com") == W.url_key("http://www2.example.com/") == "com,example)/"
    assert W.url_key(None) == W.url_key(" ") == "-" and " " not in W.url_key("http://x.y/a b\n\tc")


def table(spark):
    same = "<p>" + "é" * 80 + "</p>"
    rows = [(5, "http://a.com/x", same), (3, "http://b.com/x", same), (9, "http://a.com/x", same), (3, "http://b.com/x", same), (None, None, same), (11, "", None), (12, None, ""), (13, "http://a.com/x", "x" * 99), (14, "http://a.com/x", "x" * 99), (15, "http://a.com/x", "x" * 100), (16, "http://a.com/ x\r\ny", "x" * 100), (None, "u", "only" * 50), (None, "u", "only" * 50), (20, "http://z.z/", "L\r\n\r\n" * 60_000)]
    return rows, spark.createDataFrame([(*r, "f", 7) for r in rows], "page_id long, url string, html string, file string, offset long")


def want(rows):
    first = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and p is not None:
            first[raw] = min(first.get(raw, p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        f = first.get(raw)
        f = f if f is not None and (p is None or p > f) else None
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "response" if f is None else "revisit", f))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


def test_round_trip(spark):
    rows, df = table(spark)
    for options in ({}, {"range_lines": 2, "fan_in": 2}):
        out = W.round_trip(spark, df.repartition(5), **options).cache()
        assert got(out) == want(rows)
        history = [(r.url_key, r.captured) for r in out.orderBy("capture").collect()]
        assert history == sorted(history) and [r.capture for r in out.select("capture").orderBy("capture").collect()] == list(range(len(rows)))


def test_real_pages(spark):
    pages = real(spark, "pages")
    assert got(W.round_trip(spark, pages)) == want([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_files_are_gzip_members_of_warc(spark):
    ws = Workspace(spark, "w")
    files, made = W.write(ws, table(spark)[1].coalesce(1), F.lit(0))
    name = files.collect()[0].file
    raw = open(ws.path("archive").removeprefix("file://") + "/" + name, "rb").read()
    text = gzip.decompress(raw)
    assert text.count(b"WARC/1.1\r\n") == 14 and b"WARC-Date: 1970-01-01T00:00:00Z" in text
    entries = list(W.run_lines(ws.path("archive"), made[0]["name"]))
    assert entries == sorted(entries) and len(entries) == 14


def test_ranges_split_one_hot_key(spark):
    ws = Workspace(spark, "w")
    df = spark.range(0, 500).select(F.col("id").alias("page_id"), F.lit("http://hot.example/").alias("url"), F.concat(F.lit("payload "), F.col("id")).alias("html")).repartition(3)
    _, made = W.write(ws, df, W.by_page_id(), run_lines=40, fence=4)
    assert len(made) >= 13
    want = sorted(x for r in made for x in W.run_lines(ws.path("archive"), r["name"]))
    for fan_in in (2, 4, 128):  # four levels, two, one
        merged = W.merge(ws, made, range_lines=60, fan_in=fan_in, fence=4)
        assert [x for r in merged for x in W.run_lines(ws.path("archive"), r["name"])] == want
        assert len(merged) >= 4 and max(r["lines"] for r in merged) < 4 * 60


def test_fences_are_found(spark):
    ws = Workspace(spark, "w")
    lines = [b"%04d %s" % (k, b"x" * (k % 3000)) for k in range(0, 2000, 2)]
    run = W.RunWriter(ws.path("archive"), "r", 7)
    for x in lines:
        run.add(x)
    name = run.close()["name"]
    for low in (b"0000", b"0001", b"1", b"0998 ", b"1999", b"9", lines[14], lines[500], lines[-1]):
        assert list(W.run_lines(ws.path("archive"), name, low)) == [x for x in lines if x >= low]
        assert list(W.run_lines(ws.path("archive"), name, low, b"1500")) == [x for x in lines if low <= x < b"1500"]
    fs, root = W.pa.fs.FileSystem.from_uri(ws.path("archive"))
    with fs.open_input_file(f"{root}/{name}.fence") as f:
        want = [(int(x.partition(b" ")[0]), x.partition(b" ")[2]) for x in f.read().split(b"\n")[:-1]]
    with fs.open_input_file(f"{root}/{name}.fence") as f:
        for low in (b"0", b"0001", lines[70], lines[71], b"2"):
            assert W._fence_before(f, low) == max([a for a, x in want if x < low], default=0)


def test_empty(spark):
    assert W.round_trip(spark, table(spark)[1].limit(0)).count() == 0
