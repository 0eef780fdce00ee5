import random
import zlib

import numpy as np
import pytest
from helpers import EDGE, real, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import huffman as H
from lodestar.llm import packing as P
from lodestar.llm._common import Workspace
from lodestar.llm.tokens import PieceMemo, default_tokenizer

TRICKY = ["<|endoftext|> a <|startoftext|>b", "it's we'll I'D", "á é\ńx", "ΣΑΣ ΣΣ", "x\x1cy\x85z\xa0w v\x0bu\x0ct", "１２３ ab12cd", "‍👩‍👩‍👧 ...!!", "İstanbul ǅ ß", "", " "]


def exact(texts):
    t = Tokenizer.from_file(default_tokenizer())
    return [np.array([*x.ids, 1], np.uint32) for x in t.encode_batch(texts, add_special_tokens=False)]


def documents(spark):
    return [(r.doc_id, r.text) for r in real(spark).collect()] + [(10_000 + r[0] if r[0] else None, r[1]) for r in EDGE] + [(20_000 + i, t) for i, t in enumerate(TRICKY)]


SIGNS = ["it's o'tree 's's ''s -'s x'll 'LL'd'", "ÀÉÞß×÷ øØÿ", "a–b “q” …", "1e5,000.00%$", "x" * 5000 + " " + "é" * 3000, "don't\tCan't\r\nI'VE", "'", "''", "'t", "a'", "\x0c a\x0bb", "<|ENDOFTEXT|>"]


def test_memo_equals_tokenizer(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("ab'stdmlrveé ß.,1 \n<|") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts = [t or "" for _, t in documents(spark)] + SIGNS + noise
    want = exact(texts)
    for most in (400_000, 50, 3):
        memo = PieceMemo(default_tokenizer(), most)
        assert memo.by_model
        for size in (40, 7):
            for a in range(0, len(texts), size):
                ids, at = memo.ids([t.encode() for t in texts[a : a + size]], most=5000)
                for k, w in enumerate(want[a : a + size]):
                    assert np.array_equal(ids[at[k] : at[k + 1]], w), texts[a + k][:200]
            if most < 400_000:
                break


def test_equal_hashes_are_told_apart(monkeypatch):
    import lodestar.llm.tokens as T

    real_hashes = T.hashes
    monkeypatch.setattr(T, "hashes", lambda *a: (real_hashes(*a)[0] % np.uint64(7) + np.uint64(1), real_hashes(*a)[1]))
    text = "several words, all of them with few hashes " * 3
    ids, _ = PieceMemo(default_tokenizer()).ids([text.encode()])
    assert np.array_equal(ids, exact([text])[0])


def test_a_vocabulary_of_another_kind(monkeypatch):
    memo = PieceMemo(default_tokenizer())
    memo.by_model = False
    ids, _ = memo.ids(["Some text, it's é.".encode()], None)
    assert ids.tolist() == exact(["Some text, it's é."])[0][:-1].tolist()


def test_round_trip(spark):
    docs = documents(spark)
    got = [tuple(r) for r in H.round_trip(spark, rows(spark, docs), default_tokenizer()).collect()]
    ids = dict(zip(range(len(docs)), exact([t or "" for _, t in docs]), strict=True))
    want = {}
    for k, (d, _) in enumerate(docs):
        want.setdefault(d, []).append((len(ids[k]), zlib.crc32(ids[k].astype("<u4").tobytes())))
    mine, at = {}, 0
    for d, start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
        mine.setdefault(d, []).append((n, crc))
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert {d: sorted(x) for d, x in mine.items()} == {d: sorted(x) for d, x in want.items()}


def test_long_documents_span_segments(spark):
    sizes = [0, 1, 999, 1000, 1001, 2000, 5003, 3, 0]
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 3000, n).astype(np.uint16)) for k, n in enumerate(sizes)]
    df = spark.createDataFrame([(k, bytearray(x.tobytes()), k) for k, x in docs], "doc_id long, ids binary, place long")
    for file_bytes in (8 << 20, 6000, 500):
        files = H.write_ids(Workspace(spark, "t"), df, "<u2", file_bytes, 1000)
        back = [x for f in files for x in H.read_file(f)]
        assert [k for k, _ in back] == [k for k, _ in docs] and all(np.array_equal(a, b) for (_, a), (_, b) in zip(back, docs, strict=True))
        assert len(files) >= min(3, 2 * sum(sizes) // file_bytes)


def test_files_are_of_equal_bytes(spark):
    # 100,000 equal rows among others, and long documents in a row
    ws = Workspace(spark, "t")
    ids = F.when(F.col("id") < 100_000, F.repeat(F.lit("ab"), 20)).when(F.col("id") < 100_200, F.repeat(F.lit("cd"), 20_000)).otherwise(F.repeat(F.lit("ef"), 30)).cast("binary")
    key = F.when(F.col("id") < 100_000, F.lit(5)).otherwise(F.col("id"))
    df = ws.save(spark.range(0, 150_000, 1, 8).select(key.alias("doc_id"), ids.alias("ids"), F.col("id").alias("place")), "in")
    cuts = H.bounds(df, 1 << 19)
    sizes = [r.n for r in H.deal(df, cuts).groupBy("file").agg(F.sum(F.octet_length("ids")).alias("n")).collect()]
    assert len(sizes) == len(cuts) + 1 >= 25 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    spans = H.deal(df, cuts).groupBy("file").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("file").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))


def test_equal_rows_are_dealt(spark):
    ws = Workspace(spark, "t")
    table = ws.save(spark.range(0, 100_000, 1, 4).select(F.lit(1).alias("doc_id"), F.when(F.col("id") % 4 == 0, F.lit(512)).otherwise(F.lit(100)).cast("long").alias("length"), F.monotonically_increasing_id().alias("__place")), "in")
    out = P.assign(ws, table, 512, group=7)
    assert out.count() == 100_000 and out.select("sequence_id", "offset").distinct().count() == 100_000
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert per.filter("n <> m or n > 512").count() == 0 and per.count() == 25_000 + 75_000 // 5
    salts = table.filter("length = 100").groupBy(F.pmod(F.xxhash64("__place"), F.lit(-(-75_000 // P.SALT_ROWS)))).count().collect()
    assert max(r["count"] for r in salts) < 2 * P.SALT_ROWS


@pytest.mark.parametrize("seed", range(6))
def test_code_lengths(seed):
    rng = np.random.default_rng(seed)
    counts = np.where(rng.random(300) < 0.5, 0, (rng.pareto(0.3, 300) * 10).clip(0, 1e12).astype(np.int64) + 1)
    import heapq

    heap = [(int(c), i, ()) for i, c in enumerate(counts) if c]
    depth = {}
    heap = [(c, i, (i,)) for c, i, _ in heap]
    heapq.heapify(heap)
    tick = 1000
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            depth[i] = depth.get(i, 0) + 1
        heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
        tick += 1
    free = H.code_lengths(counts, 60)
    assert sum(int(c) * int(n) for c, n in zip(counts, free, strict=True)) == sum(int(counts[i]) * d for i, d in depth.items())
    for limit in (8, 9, 12):
        n = H.code_lengths(counts, limit)
        assert n.max() <= limit and abs(sum(2.0 ** -int(x) for x in n if x) - 1) < 1e-12 and ((n > 0) == (counts > 0)).all()


def test_one_id_and_none(spark):
    codec = H.Codec(H.code_lengths(np.array([0, 0, 5])))
    at, payload = codec.encode(np.full(700, 2))
    assert np.array_equal(codec.decode(at, payload, 700), np.full(700, 2))
    assert H.round_trip(spark, rows(spark, []), default_tokenizer()).count() == 0
    assert H.round_trip(spark, rows(spark, [(1, None)]), default_tokenizer()).collect()[0][1:3] == (0, 1)


def one_by_one(lengths, room):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free[free.index(min(fits))] -= n
        else:
            free.append(room - n)
    return len(free)


def test_plan_is_best_fit():
    rng = random.Random(7)
    for room in (10, 64, 100):
        for _ in range(40):
            lengths = [rng.randint(1, room) for _ in range(rng.randint(0, 200))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            slots, sequences = P.plan(counts, room)
            used = [[] for _ in range(sequences)]
            for n, c in counts.items():
                own = [s for s in slots if s[0] == n]
                assert [s[1] for s in own] == sorted(s[1] for s in own)
                for rank in range(c):
                    s = max((s for s in own if s[1] <= rank), key=lambda s: s[1])
                    used[s[2] + rank - s[1]].append((s[3], n))
            for x in used:
                at = 0
                for offset, n in sorted(x):
                    assert offset == at
                    at += n
                assert 0 < at <= room
            assert sequences == one_by_one(lengths, room)


def test_pack(spark):
    docs = documents(spark)
    out = P.pack(spark, rows(spark, docs), default_tokenizer(), room=512).collect()
    ids = exact([t or "" for _, t in docs])
    want = sorted(repr((d, i, p, len(x[p : p + 512]), zlib.crc32(x[p : p + 512].astype("<u4").tobytes()))) for (d, _), x in zip(docs, ids, strict=True) for i, p in enumerate(range(0, len(x), 512)))
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 512
    assert len(by) == one_by_one([r.length for r in out], 512)
    assert P.pack(spark, rows(spark, []), default_tokenizer()).count() == 0
