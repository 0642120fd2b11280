"""Bounded samples of labelled rows, and linear models fitted to them on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Range of the hashes that choose a sample.
_RANGE = 1 << 40


def bounded(rows: DataFrame, n: int, key: str, group: str | None = None) -> DataFrame:
    """Distinct values of `key`, at most `n` in each `group`, those with the smallest hash: as good as random, and the same on every run.

    Which hashes are small enough is found from the number of values first, so
    that no task gets many more than `n` of a group, however many tasks there are.
    """
    by = [group] if group else []
    rows = rows.where(F.col(key).isNotNull()).select(key, *by)
    sizes = rows.groupBy(*by).agg(F.approx_count_distinct(key).alias("__n"))
    most = F.least(F.lit(1.0), (1.3 * n + 100) / F.greatest(F.col("__n"), F.lit(1)))
    h = F.pmod(F.xxhash64(key), F.lit(_RANGE))
    few = rows.withColumn("__h", h)
    few = few.join(sizes, group) if group else few.withColumn("__n", F.lit(sizes.first()[0]))
    few = few.where(F.col("__h") <= most * _RANGE).select(key, "__h", *by).distinct()
    w = Window.partitionBy(*by) if group else Window.partitionBy(F.lit(0))
    return few.withColumn("__r", F.row_number().over(w.orderBy("__h", key))).where(F.col("__r") <= n).select(key, *by)


def one_text(rows: DataFrame, *key: str) -> DataFrame:
    """(key, text) with one text for each key: of several that with the smallest hash, then the first."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t")
    return rows.groupBy(*key).agg(least).select(*key, F.col("t.text").alias("text"))


class Sparse:
    """Rows of (index, value) pairs end to end."""

    def __init__(self, index: list[np.ndarray], value: list[np.ndarray]):
        self.index = np.concatenate(index) if index else np.zeros(0, np.int64)
        self.value = np.concatenate(value) if value else np.zeros(0)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.starts[i], self.starts[i + 1])
        return self.index[s], self.value[s]


def svm(x: Sparse, rows: np.ndarray, y: np.ndarray, width: int, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights, the bias last, of a linear support vector machine: L1 hinge loss, dual coordinate descent."""
    w = np.zeros(width + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([np.dot(v, v) + 1.0 for v in (x.row(i)[1] for i in rows)])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            index, value = x.row(rows[k])
            g = y[k] * (np.dot(w[index], value) + w[-1]) - 1
            new = min(max(alpha[k] - g / norms[k], 0.0), cost)
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w[index] += step * value
                w[-1] += step
                alpha[k] = new
    return w


def one_versus_one(x: Sparse, labels: np.ndarray, width: int, **how) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of classes (0 to n - 1), and the weights of a machine for each, as columns; positive for the first of the pair."""
    n = int(labels.max()) + 1 if len(labels) else 0
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    w = np.zeros((width + 1, len(pairs)))
    for k, (a, b) in enumerate(pairs):
        rows = np.flatnonzero((labels == a) | (labels == b))
        w[:, k] = svm(x, rows, np.where(labels[rows] == a, 1.0, -1.0), width, **how)
    return pairs, w


def vote(margins: np.ndarray, pairs: list[tuple[int, int]], n: int) -> np.ndarray:
    """Class with most pairs won; of equals the one with the larger sum of margins, then the first."""
    score = np.zeros((len(margins), max(1, n)))
    for k, (a, b) in enumerate(pairs):
        m = margins[:, k]
        squashed = np.tanh(m) * 1e-3
        score[:, a] += (m >= 0) + squashed
        score[:, b] += (m < 0) - squashed
    return score.argmax(1)
