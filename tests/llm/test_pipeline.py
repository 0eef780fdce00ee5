import corpus_pipeline as C
from helpers import EDGE, rows
from test_decontaminate import brute as contaminated
from test_pii import plain
from test_simhash import brute_groups, brute_print
from test_tokens import exact, one_by_one

from lodestar.llm import packing, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_code(spark):
    """Each stage's result on its own input, from run()'s tables written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality", "simhash", "decontaminate", "pii", "packing"]

    kept = stage["quality"](spark, docs, SF).cache()
    trees = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    every = docs.collect()
    verdict = quality.verdicts([(r.text or "").encode() for r in every], trees)[2]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r, v in zip(every, verdict, strict=True) if v)
    assert kept.columns == docs.columns

    one = stage["simhash"](spark, kept, SF).cache()
    groups = brute_groups([(r.doc_id, brute_print(r.text)) for r in kept.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted({g for *_, g in groups})

    clean = stage["decontaminate"](spark, one, SF).cache()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in contaminated([(r.doc_id, r.text) for r in one.collect()], bench) if not w[5])

    safe = stage["pii"](spark, clean, SF).cache()
    before = clean.collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in safe.collect()) == sorted((r.doc_id, t, len(t)) for r, t in zip(before, plain([r.text for r in before], pii.session_key(spark)), strict=True))
    assert safe.columns == docs.columns

    placed = stage["packing"](spark, safe, SF).collect()
    texts = [r.text for r in safe.collect()]
    assert sum(r.length for r in placed) == sum(map(len, exact(texts)))
    assert len({r.sequence_id for r in placed}) == one_by_one([r.length for r in placed], packing.LENGTH)

    again = C.run(spark, SF).collect()
    key = lambda x: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in x)
    assert key(again) == key(placed)


def test_nulls_copies_long_texts_and_clashing_columns(spark):
    """All stages on rows with null ids and texts, repeated rows and ids, empty and very long texts and more columns."""
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    name = lambda k: " ".join(f"w{k}x{i}" for i in range(200))
    docs = real + real[:40] + [(None, t) for _, t in real[20:60]] + EDGE + [(7, t) for _, t in real[:9]]
    docs += [(9000 + k, f"{name(k)}. Dr. 王小明 wrote to łukasz@śląsk.pl. {name(k + 50)}") for k in range(5)] + [(9100, name(99) * 200)]
    df, stage = rows(spark, docs), dict(C.STAGES)
    pairs = lambda x: sorted((repr(r.doc_id), repr(r.text)) for r in x)

    kept = stage["quality"](spark, df, SF).cache()
    trees = quality.train(df, spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = quality.verdicts([(t or "").encode() for _, t in docs], trees)[2]
    assert pairs(kept.collect()) == sorted((repr(d), repr(t)) for (d, t), v in zip(docs, verdict, strict=True) if v)

    one = stage["simhash"](spark, kept, SF).cache()
    left = [(r.doc_id, r.text, brute_print(r.text)) for r in kept.collect()]
    group = list(range(len(left)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (*_, a) in enumerate(left):
        for j in range(i):
            if (a ^ left[j][2]).bit_count() <= 3:
                group[find(i)] = find(j)
    members = {}
    for i, (d, t, _) in enumerate(left):
        members.setdefault(find(i), []).append((d is None, d or 0, t))
    got = one.collect()
    assert len(got) == len(members)
    first = {min(x)[:2] for x in members.values()}
    assert {(r.doc_id is None, r.doc_id or 0) for r in got} == first
    assert {(r.doc_id is None, r.doc_id or 0, r.text) for r in got} <= {x for m in members.values() for x in m}

    clean = stage["decontaminate"](spark, one, SF).cache()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(w[0]) for w in contaminated([(r.doc_id, r.text) for r in got], bench) if not w[5])

    safe = stage["pii"](spark, clean, SF).cache()
    before = clean.collect()
    assert pairs(safe.collect()) == sorted((repr(r.doc_id), repr(t)) for r, t in zip(before, plain([r.text for r in before], pii.session_key(spark)), strict=True))
    for x in (kept, one, clean, safe):
        assert x.columns == df.columns and {(r.path, r.value, r.fp, r.uid) for r in x.collect()} == {("p", 1, 2, 3)}

    placed = stage["packing"](spark, safe, SF).collect()
    assert sum(r.length for r in placed) == sum(map(len, exact([r.text for r in safe.collect()])))
    assert len({r.sequence_id for r in placed}) == one_by_one([r.length for r in placed], packing.LENGTH)


def test_empty_documents(spark, tmp_path):
    docs = rows(spark, [])
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
