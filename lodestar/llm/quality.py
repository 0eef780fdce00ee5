"""Quality rules: gradient-boosted trees over document statistics.

``document_stats`` turns a text into statistics (word counts, symbol shares, repeated lines and
word windows). ``fit`` trains boosted trees with logistic loss on labelled rows: features are
binned by quantiles, each tree grows level by level from histograms of gradients, and features
with a monotonic sign may only be split so that the prediction never moves against that sign
(child bounds are carried down the tree). The trees are flattened into numpy arrays, one row per
tree in level order, and all documents of a batch descend all trees together.

Statistics and scoring are one scan over whole texts without a shuffle. Fitting reads a bounded
sample of labelled rows (``most_labelled``, by hash of the id, cut by a threshold on the hash first),
which is broadcast to pick their texts; the statistics of these are made by all tasks and written, and
come to the driver together. Nothing else is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._common import Workspace, read, runs, texts

MOST_LABELLED = 20_000
MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "top_word_share",
    "upper_share", "digit_share", "exclaim_per_word", "pipe_per_word", "stop_per_word", "words_per_line", "short_word_share",
]
#: The kept score may only fall as these grow (-1).
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "top_word_share": -1, "exclaim_per_word": -1, "pipe_per_word": -1}
_UPPER, _DIGIT, _END = bytes(range(65, 91)), bytes(range(48, 58)), b".?"


def repeated_words(ids: np.ndarray, size: int) -> int:
    """Words that lie in a 3-word window found twice or more, the first occurrence included."""
    if len(ids) < 4:
        return 0
    pair = ids[:-2] * size + ids[1:-1]
    if size >= 1 << 20:  # a third factor would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair * size + ids[2:]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(ids), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return int(np.count_nonzero(twice | np.concatenate([[False], twice[:-1]]) | np.concatenate([[False, False], twice[:-2]])))


def document_stats(text: bytes) -> tuple[list[int], list[float]]:
    """(BASE counts, FEATURES) of a text in UTF-8; zeros for a text without words."""
    words = text.split()  # ASCII white space, as in [^\x20\x09-\x0D]+
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    n = len(words)
    if not n:
        return [0, 0, symbols, dup, 0], [0.0] * len(FEATURES)
    number: dict[bytes, int] = {}
    put = number.setdefault
    ids = np.array([put(w, len(number)) for w in words], np.int64)
    repeat = repeated_words(ids, len(number))
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    share = lambda which: len(joined) - len(joined.translate(None, which))
    return [n, chars, symbols, dup, repeat], [
        float(np.log1p(n)), chars / n, symbols / n, dup / max(lines, 1), repeat / n, len(number) / n, int(np.bincount(ids).max()) / n,
        share(_UPPER) / chars, share(_DIGIT) / chars, joined.count(b"!") / n, joined.count(b"|") / n, share(_END) / n, n / max(lines, 1), sum(map(_short, words)) / n,
    ]


def _short(word: bytes) -> bool:
    return len(word) < 3


def base_failed(counts: list[int]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]


class Trees:
    """Flattened boosted trees: arrays (tree, node) in level order; a leaf above the last level repeats its value below."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start
        self.depth = int(np.log2(value.shape[1] + 1)) - 1 if value.size else 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not self.value.size:
            return np.full(len(x), self.start)
        tree = np.arange(len(self.value))[None, :]
        node = np.zeros((len(x), len(self.value)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.start + self.value[tree, node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for y in {0, 1}. signs: +1, -1 or 0 for each feature. Without both classes the result is constant."""
    nodes = 2 ** (depth + 1) - 1
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)), 4.0 if not len(y) or y[0] else -4.0)
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # x > e[b] if code > b
    allowed = np.zeros((f, bins), bool)
    for j, e in enumerate(edges):
        allowed[j, : len(e)] = True
    cuts = np.zeros((f, bins))
    for j, e in enumerate(edges):
        cuts[j, : len(e)] = e
    mean = y.mean()
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(n, start)
    feature, threshold, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    flat = (np.arange(f) * bins)[None, :] + np.minimum(code, bins - 1)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        value[t, 0] = -g.sum() / (h.sum() + ridge)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (f * bins) + flat).ravel()
            hg = np.bincount(at, np.repeat(g, f), count * f * bins).reshape(count, f, bins)
            hh = np.bincount(at, np.repeat(h, f), count * f * bins).reshape(count, f, bins)
            gl, hl = hg.cumsum(2), hh.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            k = np.arange(first, first + count)
            vl = np.clip(-gl / (hl + ridge), low[k, None, None], high[k, None, None])
            vr = np.clip(-gr / (hr + ridge), low[k, None, None], high[k, None, None])
            score = lambda v, a, b: -(a * v + 0.5 * (b + ridge) * v * v)
            gain = score(vl, gl, hl) + score(vr, gr, hr) - score(value[t, k][:, None, None], gt, ht)
            ok = allowed[None] & (hl >= least) & (hr >= least) & ~((signs[None, :, None] * (vr - vl)) < 0)
            gain = np.where(ok, gain, -np.inf).reshape(count, -1)
            best = gain.argmax(axis=1)
            for i in range(count):
                j, b, k = *divmod(int(best[i]), bins), first + i
                left, right = 2 * k + 1, 2 * k + 2
                if gain[i, best[i]] <= 1e-9:  # a leaf: both children repeat it
                    value[t, [left, right]] = value[t, k]
                    low[[left, right]], high[[left, right]] = low[k], high[k]
                    continue
                feature[t, k], threshold[t, k] = j, cuts[j, b]
                value[t, left], value[t, right] = vl[i, j, b], vr[i, j, b]
                low[[left, right]], high[[left, right]] = low[k], high[k]
                middle = (vl[i, j, b] + vr[i, j, b]) / 2
                if signs[j] > 0:
                    high[left], low[right] = middle, middle
                elif signs[j] < 0:
                    low[left], high[right] = middle, middle
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        value[t] *= rate
        margin += value[t, node]
    return Trees(feature, threshold, value, start)


def _features(df: DataFrame) -> DataFrame:
    """label_id, label, counts and features of (label_id, label, text)."""

    def scan(batches):
        for batch in batches:
            found = [document_stats(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("label"), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["label_id", "label", "counts", "features"])

    return df.mapInArrow(scan, f"label_id {df.schema['label_id'].dataType.simpleString()}, label int, counts array<long>, features array<double>")


def train(documents: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Trees:
    """Fit on at most ``most_labelled`` rows of labels (doc_id, quality 0 or 1), chosen by hash of doc_id.

    Rows with a null id or label, and those that the base rules reject, teach nothing. Repeated rows
    of labels count once; of several documents with an id, the one with the smallest statistics teaches.
    """
    ws = Workspace(documents.sparkSession, "quality")
    labelled = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label")).filter("label_id is not null and label in (0, 1)").distinct()
    n, place = labelled.count(), F.pmod(F.xxhash64("label_id"), F.lit(1 << 40))
    if n > most_labelled:  # about as many rows as are wanted and a tenth more, so that the order is that of few rows
        labelled = labelled.filter(place < int((1 << 40) * (1.1 * most_labelled + 100) / n))
    picked = labelled.orderBy(place, "label_id", "label").limit(most_labelled)
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("label_id", "label", "text")
    one = ws.save(_features(rows).groupBy("label_id", "label").agg(F.min(F.struct("features", "counts")).alias("x")).select("label", "x.*"), "features")
    got = [(r.label, r.features) for r in one.collect() if not base_failed(r.counts)]  # at most most_labelled
    got.sort()
    x = np.array([f for _, f in got], np.float64).reshape(len(got), len(FEATURES))
    return fit(x, np.array([y for y, _ in got], np.float64), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def verdicts(texts_: list[bytes], trees: Trees) -> tuple[list[list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, kept and the score for some texts."""
    found = [document_stats(t) for t in texts_]
    failed = np.array([base_failed(c) for c, _ in found], bool)
    score = trees.probability(np.array([x for _, x in found], np.float64).reshape(len(found), len(FEATURES)))
    return [c for c, _ in found], failed, ~failed & (score >= 0.5), score


def judge(spark: SparkSession, documents: DataFrame, trees: Trees) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept and score.

    A null or empty text has no words: its counts are 0, the base rules reject it. Repeated rows are
    judged alike, null ids stay null, other columns are ignored.
    """
    sent = spark.sparkContext.broadcast(trees)
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            for a, b in runs(batch.column("text"), 16 << 20):
                counts, failed, kept, score = verdicts(list(texts(batch.column("text").slice(a, b - a))), sent.value)
                columns = np.array(counts, np.int64).reshape(len(counts), len(BASE)).T
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, columns), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    return rows.mapInArrow(scan, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, score double")


def keep(spark: SparkSession, documents: DataFrame, trees: Trees) -> DataFrame:
    """The rows that are kept, with all their columns."""
    sent = spark.sparkContext.broadcast(trees)
    at = documents.columns.index("text")

    def scan(batches):
        for batch in batches:
            for a, b in runs(batch.column(at), 16 << 20):
                yield batch.slice(a, b - a).filter(pa.array(verdicts(list(texts(batch.column(at).slice(a, b - a))), sent.value)[2]))

    return documents.mapInArrow(scan, documents.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on labels, judges the whole documents table."""
    docs = read(spark, sf_dir, "documents")
    return judge(spark, docs, train(docs, read(spark, sf_dir, "labels")))
