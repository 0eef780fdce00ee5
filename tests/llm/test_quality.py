import re

import numpy as np
from helpers import EDGE, real, rows

from lodestar.llm import quality as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for t in tri:
        seen[t] = seen.get(t, 0) + 1
    hit = {j for i, t in enumerate(tri) if seen[t] > 1 for j in range(i, i + 3)}
    lines, dup, before = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in before
            before.add(x)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_counts(spark):
    docs = [(r.doc_id, r.text) for r in real(spark).collect()] + [(r[0], r[1]) for r in EDGE]
    for _, text in docs:
        assert Q.document_stats((text or "").encode())[0] == brute(text)


def test_many_distinct_words():
    words = [b"w%d" % (i % 1_300_000) for i in range(1_300_010)]
    ids = {}
    numbers = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    assert Q.repeated_words(numbers, len(ids)) == 20


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * np.sin(3 * x[:, 2]) + rng.normal(size=4000) * 0.2) > 0).astype(float)
    trees = Q.fit(x, y, np.array([1, -1, 0]))
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.93
    for j, sign in ((0, 1), (1, -1)):
        for _ in range(30):
            line = np.repeat(rng.normal(size=(1, 3)), 200, axis=0)
            line[:, j] = np.linspace(-4, 4, 200)
            assert (sign * np.diff(trees.margin(line)) >= -1e-9).all()


def test_flattened_equals_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    t = Q.fit(x, (x[:, 0] > 0).astype(float), np.zeros(2, int), trees=5, depth=3)
    for row in x[:20]:
        m = t.start
        for k in range(len(t.value)):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (row[t.feature[k, node]] > t.threshold[k, node])
            m += t.value[k, node]
        assert abs(m - t.margin(row[None])[0]) < 1e-12


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    trees = Q.train(docs, labels.filter("doc_id % 3 > 0"))
    out = Q.judge(spark, docs, trees).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    passed = [r for r in out if not r.base_failed]
    assert sum(r.kept == bool(r.quality) for r in passed) / len(passed) > 0.95


def test_edges(spark):
    docs = rows(spark, EDGE)
    labels = spark.createDataFrame([(1, 1), (None, 0), (5, None), (7, 0)], "doc_id long, quality int")
    trees = Q.train(docs, labels)
    out = Q.judge(spark, docs, trees).collect()
    assert sorted((repr(r.doc_id), r.n_words) for r in out) == sorted((repr(r[0]), brute(r[1])[0]) for r in EDGE)
    assert all(not r.kept for r in out if r.n_words < 50) and all(r.base_failed == (r.n_words < 50 or r.n_repeat_words * 2 > r.n_words) for r in out)
    assert Q.keep(spark, docs, trees).count() == sum(r.kept for r in out)
    empty = Q.train(docs.limit(0), labels)
    assert Q.judge(spark, docs.limit(0), empty).count() == 0


def test_sample_of_labels(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(60 + k % 7))) for k in range(300)] + [(7, "again and again " * 40)] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] * 3, "doc_id long, quality int")
    seen = []
    fit, Q.fit = Q.fit, lambda x, y, *a: seen.append(len(y)) or fit(x, y, *a)
    try:
        Q.train(docs, labels, 40)
        Q.train(docs, labels)
    finally:
        Q.fit = fit
    assert 20 <= seen[0] <= 40 and seen[1] <= 300
