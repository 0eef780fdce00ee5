import hashlib
import random
import re

from helpers import EDGE, real, rows

from lodestar.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, bench):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    pats = {}
    for item, text in bench:
        w = WORD.findall(low(text))
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            pats.setdefault(tuple(w[k : k + m]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, items = WORD.findall(low(text)), set(), set()
        for m in {len(p) for p in pats}:
            for k in range(len(w) - m + 1):
                if found := pats.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    items |= found
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], key=repr)


def test_real_rows(spark):
    docs, bench = real(spark), real(spark, "benchmark")
    assert got(D.contamination(spark, docs, bench)) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


def test_small_vocabulary_and_edges(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs = [(i, text(rng.randint(0, 900))) for i in range(60)] + [(100, "X" + text(300).upper()), *[(r[0], r[1]) for r in EDGE]]
    bench = [(i, text(rng.randint(0, 16))) for i in range(40)] + [(50, None), (51, "..."), (52, "café"), (53, "word0 tail0 word1 tail1 " * 4)]
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    assert got(D.contamination(spark, rows(spark, docs), items)) == want
    assert got(D.contamination(spark, rows(spark, docs), items, block_bytes=60)) == want
    for kept in (D.clean(spark, rows(spark, docs), items), D.clean(spark, rows(spark, docs), items, block_bytes=60)):
        assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(w[0]) for w in want if not w[5])


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert got(D.contamination(spark, rows(spark, []), bench)) == []
    assert not any(r[5] for r in got(D.contamination(spark, rows(spark, EDGE), bench)))


def test_tables_are_small_and_sent_whole():
    import pickle
    import time

    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(30_000)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randint(1, 400))).encode()) for i in range(1600)]
    items += [(f"copy{i}", items[0][1]) for i in range(500)]  # one text in very many items
    size, began = sum(len(t) for _, t in items), time.perf_counter()
    sent = pickle.dumps(D.Patterns(items))
    assert size > 2_000_000 and len(sent) < 40 * size and time.perf_counter() - began < 30
    patterns = pickle.loads(sent)
    words = [D.words(t) for _, t in items]
    docs = [b" ".join(words[k][:60]) + b" between " + b" ".join(words[k + 1][5:17]) for k in range(0, 400, 7)] + [b"", items[0][1]]
    assert [(n, p.tolist(), x) for n, p, x in patterns.search(docs)] == [(n, p.tolist(), x) for n, p, x in D.Patterns(items).search(docs)]
    assert patterns.search([items[0][1]])[0][2] >= {"0", *(f"copy{i}" for i in range(500))}


def test_clashing_columns_in_several_blocks(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", "a", 1), (None, "one two three four five six", "b", 2), (2, "clean " * 30, "c", 3), (3, None, "d", 4)], "doc_id long, text string, __sha string, __bad long")
    bench = spark.createDataFrame([(1, "two three four"), (2, "five six")], "item_id long, text string")
    kept = D.clean(spark, docs, bench, block_bytes=5)
    assert kept.columns == docs.columns and sorted(r["__bad"] for r in kept.collect()) == [3, 4]
