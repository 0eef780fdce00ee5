import random
import re

import numpy as np
import xxhash
from helpers import EDGE, real, rows

from lodestar.llm import simhash as S
from lodestar.llm._common import Workspace


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(prints):
    """prints: [(id, fp)] -> [(id, hex, component)]"""
    fps = sorted({f for _, f in prints})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 3):
            x, y = root(f), root(fps[j])
            up[max(x, y)] = min(x, y)
    ids = {}
    for i, f in prints:
        if i is not None:
            ids[root(f)] = min(ids.get(root(f), i), i)
    return sorted([(i, f"{f:016x}", ids.get(root(f))) for i, f in prints], key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_real_and_edges(spark):
    docs = [(r.doc_id, r.text) for r in real(spark).collect()] + [(10_000 + r[0] if r[0] else None, r[1]) for r in EDGE]
    want = brute_groups([(i, brute_print(t)) for i, t in docs])
    assert got(S.groups(spark, rows(spark, docs))) == want
    kept = S.dedup(spark, rows(spark, docs))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == rows(spark, []).columns and len(ids) == len({w[2] for w in want})
    assert sorted(x for x in ids if x is not None) == sorted({w[2] for w in want} - {None})


def near_prints(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set(base)
    while len(out) < n:
        f = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


def test_sharded_trees_lose_no_link(spark):
    rng = random.Random(1)
    fps = near_prints(rng, 1500) + [(7 << 60) | x for x in range(300)]  # the last lie close together
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute_groups(list(enumerate(fps)))
    for most in (4096, 20):  # 20: shards are split down to the last level
        ws = Workspace(spark, "test")
        label = {r.fp % (1 << 64): r.label for r in S.link(ws, df, most).collect()}
        mine = {}
        for k, f in enumerate(fps):
            mine.setdefault(label.get(f, ("alone", f)), []).append(k)
        assert sorted(mine.values()) == sorted(_by(want).values())


def _by(want):
    out = {}
    for k, _, c in want:
        out.setdefault(c, []).append(k)
    return {c: sorted(v) for c, v in out.items()}


def test_forest_finds_all_neighbours():
    rng = random.Random(2)
    fps = np.array(near_prints(rng, 700), np.uint64)
    tree = S.Forest(np.zeros(len(fps), np.int64), fps)
    q, node = tree.near(np.arange(len(fps)))
    want = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist() if i != j}
    assert set(zip(q.tolist(), node.tolist(), strict=True)) == want


def test_blocks_leave_no_bit():
    for level in range(S.LEVELS):
        for path in (0, 4**level - 1):
            bits = S.left_bits(path, level)
            assert sorted(sum(S.blocks(bits), [])) == bits
    assert all(len(S.left_bits(p, S.LEVELS)) <= 16 for p in range(4**S.LEVELS))


def test_empty(spark):
    assert got(S.groups(spark, rows(spark, []))) == [] and S.dedup(spark, rows(spark, [])).count() == 0
