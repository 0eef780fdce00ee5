from helpers import EDGE, real, rows

from lodestar.llm import langid as L


def test_held_out_accuracy(spark):
    docs = L.fold(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    profiles = L.learn(docs.filter("not held_out"))
    assert [x for x, _ in profiles] == ["de", "en", "es", "fr"] and all(len(p) == L.PROFILE for _, p in profiles)
    out = L.identify(spark, docs, profiles, ["doc_id", "held_out"]).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) > 200
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_profile_counts_match_brute_force(spark):
    from collections import Counter

    docs = real(spark).filter("lang = 'fr'")
    counts = Counter()
    for r in docs.collect():
        norm = "".join(c.lower() if c.isalpha() else " " for c in r.text).split()
        for w in norm:
            counts.update(w)
            counts.update((" " + w + " ")[i : i + 2] for i in range(len(w) + 1))
            counts.update((" " + w + " ")[i : i + 3] for i in range(len(w)))
    number = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    want = [g for g, _ in sorted(((number(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][: L.PROFILE]
    assert L.learn(docs) == [("fr", want)]


def test_edges(spark):
    docs = L.fold(rows(spark, [(*r, "xx") for r in EDGE] + [(20, "9 8 7 !!", "yy")]))
    profiles = L.learn(docs)
    assert [x for x, _ in profiles] == ["xx"]
    out = {(r.doc_id, r.lang_pred) for r in L.identify(spark, docs, profiles, ["doc_id"]).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (None, "und"), (None, "xx"), (20, "und"), (7, "xx")} <= out
    assert L.learn(docs.limit(0)) == []
    assert {r.lang_pred for r in L.identify(spark, docs, [], ["doc_id"]).collect()} == {"und"}
    assert L.identify(spark, docs.limit(0), profiles, ["doc_id"]).count() == 0


def test_lang_is_no_input(spark):
    a = rows(spark, [(1, "bonjour tout le monde", "fr")])
    b = rows(spark, [(1, "bonjour tout le monde", "en")])
    profiles = [("en", [ord("t"), ord("h")]), ("fr", [ord("o"), ord("u")])]
    assert [r.lang_pred for r in L.identify(spark, a, profiles, []).collect()] == [r.lang_pred for r in L.identify(spark, b, profiles, []).collect()]


def test_no_language_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2, raising=False)  # a cap that there was
    docs = spark.createDataFrame([(f"{chr(97 + k)}{chr(98 + k)} word", f"l{k}") for k in range(9)], "text string, lang string")
    learned = L.learn(docs, 5)
    assert [x for x, _ in learned] == [f"l{k}" for k in range(9)] and all(len(p) == 5 for _, p in learned)
