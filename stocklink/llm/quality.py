"""Document quality: histogram gradient-boosted trees over document statistics.

The statistics of a text are numbers only: sizes, shares of character classes,
word and line repetition.  Trees are grown level by level on binned
statistics, and flattened into arrays (statistic, threshold and value of each
node of a complete binary tree), which are walked by all documents at once.

Labels are taken from rows whose crc32(doc_id as text) modulo ``FOLDS`` isn't
0.  At most ``MAX_TRAIN`` labelled documents are used, those with the smallest
hash of doc_id, so the bounded sample that reaches the driver doesn't depend
on the order of rows.  A label of a doc_id that has several is the smallest.

Null and empty texts are scored like any other; without usable labels every
score is 0.5; repeated rows are scored each; further columns pass by unread.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, strings

FOLDS, MAX_TRAIN, CUT = 5, 20_000, 0.3
TREES, DEPTH, RATE, BINS, LEAF, L2 = 120, 4, 0.1, 64, 20, 1.0

#: Classes of UTF-8 bytes whose share of a text is a statistic.
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "newline": (10,), "bang": (33, 63), "stop": (46,), "comma": (44, 59, 58),
    "symbol": tuple(b"#*$%&|<>"), "bar": (124,), "bracket": tuple(b"()[]{}"), "slash": tuple(b"/\\_=+~^@"), "quote": tuple(b"\"'`"), "high": range(128, 256), "control": (*range(9), *range(11, 32), 127),
}
STATISTICS = ["log_bytes", "log_words", *CLASSES, "word_bytes", "longest_word", "distinct_words", "top_word", "short_words", "long_words", "log_lines", "line_bytes", "repeated_lines", "short_lines", "ended_lines", "entropy", "repeated_pairs", "upper_words"]

_CLASS = np.zeros((256, len(CLASSES)))
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes), _k] = 1


def statistics(text: str) -> list[float]:
    """The numbers named in ``STATISTICS`` for a whole text."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = (counts @ _CLASS / max(1, n)).tolist()
    words = data.split()
    m = max(1, len(words))
    seen = Counter(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    p = counts[counts > 0] / max(1, n)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n), math.log1p(len(words)), *shares, float(lens.sum()) / m, math.log1p(int(lens.max(initial=0))), len(seen) / m, (max(seen.values()) if seen else 0) / m, float((lens <= 2).sum()) / m, float((lens >= 12).sum()) / m,
        math.log1p(len(lines)), sum(map(len, lines)) / k, 1 - len(set(lines)) / k if lines else 0.0, sum(len(x) < 30 for x in lines) / k, sum(x[-1:] in b".!?" for x in lines) / k, float(-(p * np.log2(p)).sum()), 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, sum(map(bytes.isupper, words)) / m,
    ]


@dataclass
class Forest:
    """Trees as complete binary trees of one depth, level by level; a node without a split sends all to the left."""

    base: float
    statistic: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.statistic.shape[1]
        for statistic, threshold, value in zip(self.statistic, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, statistic[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Fit a forest to labels 0 and 1 by logistic loss."""
    inner = 2**depth - 1
    if not len(y):
        return Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = math.log(mean / (1 - mean))
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)])
    total = np.full(len(y), base)
    out = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            gains = np.zeros((len(x.T), width))
            at = np.zeros((len(x.T), width), np.int64)
            for f, column in enumerate(binned):
                cell = node * bins + column
                g, h, n = (np.bincount(cell, w, width * bins).reshape(width, bins).cumsum(1) for w in (grad, hess, None))
                left, right = g**2 / (h + L2), (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + L2)
                gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + L2)
                gain[(n < LEAF) | (n[:, -1:] - n < LEAF)] = 0
                gain[:, len(cuts[f]) :] = 0
                at[f] = gain.argmax(1)
                gains[f] = gain.max(1)
            best = gains.argmax(0)
            for k in range(width):
                f = int(best[k])
                if gains[f, k] > 1e-9:
                    out.statistic[t, first + k], out.threshold[t, first + k] = f, cuts[f][at[f, k]]
            limit = np.where(np.isfinite(out.threshold[t, first + np.arange(width)]), at[best, np.arange(width)], bins)
            node = 2 * node + (binned[best[node], np.arange(len(y))] > limit[node])
        g, h = (np.bincount(node, w, inner + 1) for w in (grad, hess))
        out.value[t] = -rate * g / (h + L2)
        total += out.value[t][node]
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo ``FOLDS``; a null doc_id counts as an empty text, so it is in fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def training_labels(labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> DataFrame:
    """doc_id and y of the bounded sample of labelled documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(fold(F.col("doc_id")) != 0)
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> Forest:
    """A forest from the documents of ``training_labels``, whose statistics are gathered on the driver: ``most`` rows at most, since of a doc_id's texts the one with the smallest hash counts."""
    chosen = F.broadcast(training_labels(labels, label, most))  # at most ``most`` rows of two numbers

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [statistics(t) for t in strings(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["key", "x"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    measured = joined.select(F.struct("doc_id", F.xxhash64("text").alias("h"), "y").alias("key"), "text").mapInArrow(measure, "key struct<doc_id:long,h:long,y:int>, x array<double>")
    got = measured.groupBy("key.doc_id").agg(F.min(F.struct("key.h", "key.y", "x")).alias("r")).select("r.y", "r.x").toArrow()
    # their order is made the same in every run
    rows = sorted(zip(got.column("y").to_pylist(), got.column("x").to_pylist(), strict=True), key=lambda r: (r[1], r[0]))
    return train(np.asarray([r[1] for r in rows]).reshape(len(rows), len(STATISTICS)), np.asarray([r[0] for r in rows], np.float64))


def score(docs: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # trees x 2**(depth + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            x = np.asarray([statistics(t) for t in strings(batch.column(2))]).reshape(batch.num_rows, len(STATISTICS))
            got = shared.value.scores(x)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that aren't rejected, with their own columns."""
    forest = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def kept(texts: pa.Array) -> pa.Array:
        x = np.asarray([statistics(t) for t in strings(texts)]).reshape(len(texts), len(STATISTICS))
        return pa.array(shared.value.scores(x) >= cut)

    return docs.where(F.arrow_udf(kept, "boolean")(F.col("text").cast("string")))
