"""Quality rules: fixed base rules, then an isolation forest on rule statistics.

The forest is fitted on a bounded sample (``SAMPLE`` rows, those of the least hash) of
the rows labelled good; its random splits are drawn from each node's range and a
margin around it, so that documents outside all good ranges fall into empty leaves
early. A document's height is its mean path length over all trees. The height
below which documents are anomalous is taken from the histogram of heights of all
labelled rows.

What reaches the driver: the sample, and at most 2 x 100 x (LIMIT + 2) histogram counts.

Defined results: null texts are empty and fail the base rules; without rows labelled
good there is no forest and the base rules alone decide; without rows labelled bad
the threshold lets all labelled rows pass; null labels are not used; other columns are not
looked at; repeated rows get the same verdict each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm import stats
from isohyet.llm.common import least_hashed, small_batches, written
from isohyet.llm.quality import matrix

SAMPLE = 8192
TREES = 100
ROWS_A_TREE = 256
LIMIT = 16  # splits on a path
MARGIN = 0.5  # of the range that splits are drawn from, around a node's rows
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words
#: What a good row lost weighs against a bad row kept.
LOSS = 20.0
_AT = {name: k for k, name in enumerate(stats.COUNTS)}


def ratios(counts: np.ndarray) -> np.ndarray:
    """The forest's statistics, free of the text's length."""
    c = {name: counts[:, k].astype(float) for name, k in _AT.items()}
    words = np.maximum(c["n_words"], 1)
    top = [c["n_symbols"] / words, c["n_echoes"] / words, c["n_repeat_words"] / words, c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_bangs"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1)]
    return np.sqrt(np.stack(top, axis=1))


def _depth(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    def __init__(self, rows: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES if len(rows) else 0):
            nodes: list[list[float]] = []
            self._grow(nodes, rows[rng.choice(len(rows), min(ROWS_A_TREE, len(rows)), replace=False)], np.full(rows.shape[1], -np.inf), np.full(rows.shape[1], np.inf), 0, rng)
            feature, at, left, right, height = np.array(nodes).T
            self.trees.append((feature.astype(int), at, left.astype(int), right.astype(int), height))
        self.threshold = -np.inf

    def _grow(self, nodes: list, rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        own = len(nodes)
        nodes.append([0, 0, own, own, depth + _depth(len(rows))])
        if len(rows) > 1 and depth < LIMIT:
            f = int(rng.integers(rows.shape[1]))
            at = rng.uniform(max(rows[:, f].min() - MARGIN, low[f]), min(rows[:, f].max() + MARGIN, high[f]))
            below = rows[:, f] < at
            a, b = high.copy(), low.copy()
            a[f] = b[f] = at
            nodes[own][0], nodes[own][1] = f, at
            nodes[own][2] = self._grow(nodes, rows[below], low, a, depth + 1, rng)
            nodes[own][3] = self._grow(nodes, rows[~below], b, high, depth + 1, rng)
        return own

    def height(self, rows: np.ndarray) -> np.ndarray:
        total, own = np.zeros(len(rows)), np.arange(len(rows))
        for feature, at, left, right, height in self.trees:
            node = np.zeros(len(rows), int)
            for _ in range(LIMIT):
                node = np.where(rows[own, feature[node]] < at[node], left[node], right[node])
            total += height[node]
        return total / max(1, len(self.trees))

    def calibrate(self, histogram: dict[tuple[int, int], int]) -> None:
        """The bound of the least loss over bins of heights in hundredths; the middle of ties."""
        bins = np.arange(100 * (LIMIT + 12))
        good, bad = (np.bincount([b for b, y in histogram if y == label], weights=[n for (_, y), n in histogram.items() if y == label], minlength=len(bins)) for label in (1, 0))
        loss = LOSS * np.cumsum(np.append(0, good)) / max(1, good.sum()) - np.cumsum(np.append(0, bad)) / max(1, bad.sum())
        best = np.flatnonzero(loss <= loss.min() + 1e-12)
        run = best[: np.flatnonzero(np.diff(np.append(best, -9)) != 1)[0] + 1]
        self.threshold = (0 if not bad.sum() else (run[0] + run[-1]) / 2) / 100

    def kept(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, height and kept for rows of counts."""
        words, repeated = counts[:, _AT["n_words"]], counts[:, _AT["n_repeat_words"]]
        failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
        height = self.height(ratios(counts))
        return failed, height, ~failed & (height >= self.threshold)


def fit(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Forest:
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    rows = written(counts.join(known, F.col(id_col) == F.col("_id")).select(F.col("_id").cast("string").alias("_id"), "_label", "counts"))
    good = rows.where("_label = 1").withColumn("_h", F.xxhash64("_id", "counts"))
    some = least_hashed(good, "_h", SAMPLE).orderBy("_h", "_id", "counts").limit(SAMPLE).select("counts").collect()
    forest = Forest(ratios(np.array([r["counts"] for r in some], float).reshape(-1, len(stats.COUNTS))))
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (100 * shared.value.height(ratios(matrix(b.column(1))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0)], names=["bin", "label"])

    if len(some):
        found = rows.select("_label", "counts").mapInArrow(bins, "bin int, label int").groupBy("bin", "label").count().collect()
        forest.calibrate({(r["bin"], r["label"]): r["count"] for r in sorted(found)})
    return forest


def judge(counts: DataFrame, forest: Forest, id_col: str = "doc_id") -> DataFrame:
    """(id, counts, base_failed, height, kept) of every row of counts."""
    shared = counts.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = map(pa.array, shared.value.kept(matrix(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["id", "counts", "base_failed", "height", "kept"])

    kind = counts.schema[id_col].dataType.simpleString()
    return counts.select(id_col, "counts").mapInArrow(run, f"id {kind}, counts array<bigint>, base_failed boolean, height double, kept boolean").withColumnRenamed("id", id_col)


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    counts = written(stats.counted(docs, id_col, text_col))
    return judge(counts, fit(counts, labels, id_col, label_col), id_col)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Texts are counted twice, for the fit and for the verdict: cheaper than a shuffle of texts.
    """
    forest = fit(stats.counted(docs, id_col, text_col), labels, id_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("boolean")
    def passes(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(shared.value.kept(np.array([stats.count(t or "") for t in texts], np.int64).reshape(-1, len(stats.COUNTS)))[2])

    return small_batches(docs).where(passes(F.col(text_col)))
