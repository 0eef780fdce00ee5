"""Language identification by rank-order n-gram profiles (out-of-place distance).

Learning counts the 1- to 3-grams of all learning texts of each language, and keeps as the
language's profile the ``PROFILE`` most frequent ones in order. A document is compared by its own
most frequent n-grams: for each, the distance adds how many places its rank is from the rank in
the profile, or the full profile length where the profile lacks it. The nearest profile wins.

Texts are lower-cased; runs of characters that are no letters become one space, which n-grams may
hold once at a word's edge. An n-gram is a 63-bit integer of code points, so that counting is
sorting of numpy arrays. Ties in count are broken by that integer, ties in distance by the name
of the language. Counting is a scan with one partial count per task and a small aggregation, over
all learning rows; the profiles (languages x ``PROFILE`` integers) are broadcast. Scoring is a scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm._common import read, runs, schema, texts

PROFILE = 400
_FLUSH = 1 << 20
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space where it is no letter."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x110000, 32, np.int32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low[0]) if low[0].isalpha() else c
        _LETTER = table
    return _LETTER


def normal(text: bytes) -> np.ndarray:
    """Letters in lower case with single spaces between and around words; empty if there is no letter."""
    if text.isascii():
        points = np.frombuffer(text, np.uint8)
    else:
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    chars = _letters()[points]
    gap = chars == 32
    if gap.all():
        return chars[:0]
    chars = np.concatenate([[np.int32(32)], chars, [np.int32(32)]])
    gap = np.concatenate([[True], gap, [True]])
    return chars[~gap | np.concatenate([[True], ~gap[:-1]])]


def grams(chars: np.ndarray) -> np.ndarray:
    """All 1- to 3-grams as integers; a space counts only at the edge of a word."""
    c = chars.astype(np.int64)
    one = c[c != 32]
    two = (c[:-1] << 21) | c[1:]
    three = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[c[1:-1] != 32]
    return np.concatenate([one, two, three])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def top(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; equal counts in order of the integer."""
    if len(keys) > most:  # all that can be among them, ties at the edge included
        edge = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= edge], counts[counts >= edge]
    return keys[np.argsort(-counts, kind="stable")][:most]


def learn(documents: DataFrame, most: int = PROFILE) -> list[tuple[str, list[int]]]:
    """The profiles from the rows of (text, lang); rows without either teach nothing.

    All rows count. Each task sends its counts once they pass about a million n-grams, so memory is
    bounded; the counts are summed by (language, n-gram), and each language's first ones are kept.
    The profiles of all languages come to the driver: its memory bounds how many there can be.
    """

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, pieces in held.items():
                keys = np.concatenate([k for k, _ in pieces])
                numbers = np.concatenate([n for _, n in pieces])
                order = np.argsort(keys)
                keys, numbers = keys[order], numbers[order]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array(keys[first]), pa.array(np.add.reduceat(numbers, first).astype(np.int64))], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for k, text in enumerate(texts(batch.column("text"))):
                keys, numbers = counted(grams(normal(text)))
                if len(keys):
                    held.setdefault(langs[k], []).append((keys, numbers))
                    size += len(keys)
                if size >= _FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    rows = documents.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= most)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in ranked.select("lang", "gram", "r").collect():
        profiles.setdefault(row.lang, []).append((row.r, row.gram))
    return [(lang, [g for _, g in sorted(x)]) for lang, x in sorted(profiles.items())]


class Ranker:
    """Profiles as one sorted array of n-grams with each language's rank of it."""

    def __init__(self, profiles: list[tuple[str, list[int]]], most: int = PROFILE):
        self.names, self.most = [x for x, _ in profiles], most
        self.known = np.unique(np.array([g for _, p in profiles for g in p], np.int64))
        self.rank = np.full((len(self.known) + 1, len(profiles)), -1, np.int64)  # the last row: in no profile
        for j, (_, p) in enumerate(profiles):
            self.rank[np.searchsorted(self.known, np.array(p, np.int64)), j] = np.arange(len(p))

    def predict(self, text: bytes) -> tuple[str, float]:
        chars = normal(text)
        if not len(chars) or not self.names:
            return "und", 0.0
        own = top(*counted(grams(chars)), self.most)
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        rank = self.rank[at]
        away = np.where(rank < 0, self.most, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.most * len(own)))


def identify(spark: SparkSession, documents: DataFrame, profiles: list[tuple[str, list[int]]], keep: list[str]) -> DataFrame:
    """Each row's columns ``keep`` with lang_pred and score (1: the profile itself, 0: nothing in common).

    Only the text is looked at. A null text, or one without a letter, is ``und`` with score 0, and so
    is everything where no language was learned. Columns of the input named like a result are dropped.
    """
    sent = spark.sparkContext.broadcast(profiles)
    rows = documents.select(*keep, F.col("text").alias("__text"))
    at = len(keep)

    def score(batches):
        ranker = Ranker(sent.value)
        for batch in batches:
            for a, b in runs(batch.column(at)):
                part = batch.slice(a, b - a)
                found = [ranker.predict(t) for t in texts(part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(score, schema(rows, keep, "lang_pred string, score double"))


def fold(documents: DataFrame) -> DataFrame:
    """doc_id, text, lang and held_out; a null id is not held out, nor learned from."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    return documents.select("doc_id", "text", "lang", F.coalesce(rest == 2, F.lit(False)).alias("held_out"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from all documents that are not held out, predicts all documents."""
    docs = fold(read(spark, sf_dir, "documents"))
    profiles = learn(docs.filter("not held_out and doc_id is not null"))
    return identify(spark, docs, profiles, ["doc_id", "held_out"])


#: A CRC-32 by its table; letters as Unicode has them.
ORACLE_SQL = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(0, 256) x(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) AS n,
  list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) % 256) + 1])) AS c FROM documents, crc),
f AS (SELECT rid, doc_id, lang, coalesce(xor(c, 4294967295) % 4 = 2, false) AS held_out, list_transform(string_split(' ' || n || ' ', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS l FROM d),
u AS (SELECT rid, unnest(l) AS a, unnest(l[2:]) AS b, unnest(l[3:]) AS c FROM f JOIN d USING (rid) WHERE n <> ''),
g AS (SELECT rid, g, count(*) AS n FROM (SELECT rid, a AS g FROM u WHERE a <> 32 UNION ALL SELECT rid, a * 2097152 + b FROM u WHERE b IS NOT NULL
  UNION ALL SELECT rid, a * 4398046511104 + b * 2097152 + c FROM u WHERE c IS NOT NULL AND b <> 32) GROUP BY rid, g),
p AS (SELECT lang, g, r FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS r FROM g JOIN f USING (rid) WHERE NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL GROUP BY lang, g) WHERE r < 400),
own AS (SELECT rid, g, r, count(*) OVER (PARTITION BY rid) AS m FROM (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, g) - 1 AS r FROM g) WHERE r < 400),
away AS (SELECT rid, l.lang, any_value(m) AS m, sum(coalesce(abs(p.r - own.r), 400)) AS x FROM own CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.g = own.g GROUP BY rid, l.lang),
best AS (SELECT rid, lang, 1 - CAST(x AS DOUBLE) / CAST(400 * m AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY x, lang) AS k FROM away) WHERE k = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0) AS score FROM f LEFT JOIN best USING (rid)
"""
