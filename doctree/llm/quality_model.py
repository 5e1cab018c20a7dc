"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted inside Arrow batches. Labelled rows, a bounded sample of them in order
of hash, train the trees on the driver: features are cut into quantile bins, and each level of a tree
takes its splits from sums of gradients by node, feature and bin. The trees are complete, so all of them
flatten into three arrays, and a batch walks down with one numpy step for each level.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.llm.common import held_out, slices, table

#: Labelled rows that train the model: a documented bound, 40,000 rows of statistics have 10 MB.
MOST_LABELS = 40_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.15
SHRINK = 1.0
LEAST_WEIGHT = 2.0

_SYMBOLS = "#*$%&|<>"
#: Classes of bytes that are counted: upper, lower, digit, blank, line end, symbol, end of sentence, '!', other ASCII, rest.
_CLASS = np.full(256, 9, np.uint8)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 0 if "A" <= _s <= "Z" else 1 if "a" <= _s <= "z" else 2 if _s.isdigit() else 4 if _s == "\n" else 3 if _s.isspace() else 5 if _s in _SYMBOLS else 6 if _s in ".?" else 7 if _s == "!" else 8
FEATURES = (
    "log_words", "log_bytes", "word_length", "upper", "lower", "digit", "blank", "line_end", "symbol", "sentence_end",
    "exclamation", "other_ascii", "non_ascii", "distinct_words", "most_common_word", "repeated_pairs", "repeated_lines",
    "words_per_line", "words_per_sentence", "one_letter_words", "longest_word", "distinct_of_first_letters",
)


def statistics(texts: list[str | None]) -> np.ndarray:
    """The features of each text as rows. A null text is as an empty one; all its shares are 0."""
    out = np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "replace")
        share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10) / len(raw)
        words = raw.split()
        n = len(words)
        if not n:
            out[k, 1] = np.log1p(len(raw))
            out[k, 3:13] = share
            continue
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lines = [x for x in raw.split(b"\n") if x.strip()]
        size = np.fromiter(map(len, words), np.int64, n)
        ends = max(1.0, share[6] * len(raw))
        pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 1
        out[k] = [
            np.log1p(n), np.log1p(len(raw)), size.mean(), *share, len(counts) / n, max(counts.values()) / n,
            1 - pairs / max(1, n - 1), 1 - len(set(lines)) / len(lines), n / len(lines), n / ends, (size == 1).mean(),
            min(int(size.max()), 1000), len({w[:1] for w in counts}) / len(counts),
        ]
    return out


def _features(text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        rows = np.concatenate([statistics(p.to_pylist()) for p in slices(texts)]) if len(texts) else np.zeros((0, len(FEATURES)))
        return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32), rows.ravel())

    return F.arrow_udf(of, "array<double>")(text)


class Trees(NamedTuple):
    """Complete trees of one depth, flattened. Node i has children 2i + 1 and 2i + 2; values are those of the leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        at, inner = np.arange(len(rows)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (rows[at, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(rows)))


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boost ``trees`` trees on the logistic loss. Without rows, or with one label only, the score is the share of ones."""
    n, width = rows.shape
    inner = 2**depth - 1
    share = (labels.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(rows[:, f], np.arange(1, BINS) / BINS)) for f in range(width)]
    bins = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], 1)
    slot = bins + np.arange(width) * BINS
    margin = np.full(n, base)
    found = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, weight = labels - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (width * BINS) + slot).ravel()
            g = np.bincount(where, np.repeat(grad, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2)
            h = np.bincount(where, np.repeat(weight, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + SHRINK) + (all_g - g) ** 2 / (all_h - h + SHRINK) - all_g**2 / (all_h + SHRINK)
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = 0
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(nodes, -1).max(1) > 1e-9):
                f, b = divmod(int(best[k]), BINS)
                feature[first + k], threshold[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, weight, inner + 1) + SHRINK)
        margin += value[leaf]
        for out, x in zip(found, (feature, threshold, value), strict=True):
            out.append(x)
    return Trees(base, *(np.stack(x) for x in found))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELS) -> Trees:
    """The model of at most ``most`` labelled ids. Labels are grouped by id; ids whose labels disagree teach nothing.

    Null ids, null labels and labelled ids without a document teach nothing either. Of an id that several documents
    have, the text whose hash is least teaches, so the same rows give the same model. Texts are measured where they
    are; only the statistics are shuffled.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("d")).agg(F.min(label).alias("y"), F.max(label).alias("most"))
    known = known.where("y = most").select("d", "y").orderBy(F.xxhash64("d"), "d").limit(most)
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(known), "d")
    one = F.min(F.struct(F.xxhash64("t").alias("h"), _features(F.col("t")).alias("x"))).alias("one")
    found = sorted((r.d, int(r.y), r.x) for r in rows.groupBy("d", "y").agg(one).select("d", "y", "one.x").collect())
    x = np.array([r[2] for r in found]).reshape(len(found), len(FEATURES))
    return fit(x, np.array([min(max(r[1], 0), 1) for r in found], float))


def scored(text: Column, model: Trees) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.score(statistics(p.to_pylist())) for p in slices(texts)]) if len(texts) else np.zeros(0))

    return F.arrow_udf(of, "double")(text)


def op8_histogram_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), scored(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op8_histogram_boosted_quality": op8_histogram_boosted_quality}
ORACLE_SQL: dict[str, str] = {}
