"""Quality score: a regularised quadratic discriminant over transformed document counts.

Class means and covariances come from one pass of sums over all labelled training rows;
covariances are shrunk towards their diagonals and kept as inverse Cholesky factors. A
document's margin is the difference of the two Mahalanobis log densities; a logistic
curve, fitted to the histogram of training margins, makes it a score from 0 to 1.

Only what reaches the driver: 2 x (1 + d + d^2) sums and at most 2 x 2,001 histogram
counts, whatever the corpus. Labels are joined by id to small count rows, never to texts.

Defined results: null texts are empty texts and get the score of one; rows without id
are scored too, and count as held out of training; null labels are not used; with
no training row of one class, every score is the other class's (0 or 1; 0.5 with
none at all); a document labelled more than once counts once for each label; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm import stats
from isohyet.llm.common import written

SHRINKAGE = 0.05
RIDGE = 1e-4
REACH = 1000.0  # margins are cut off there before the logistic curve
PREDICT_AT = 0.3
_AT = {name: k for k, name in enumerate(stats.COUNTS)}


def features(counts: np.ndarray) -> np.ndarray:
    """Transformed statistics, a row for each row of counts."""
    c = {name: counts[:, k].astype(float) for name, k in _AT.items()}
    words, inside, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_letters"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words / 10,
            np.sqrt(c["n_symbols"] / words),
            np.sqrt(c["n_echoes"] / words),
            np.sqrt(c["n_repeat_words"] / words),
            np.sqrt(c["n_upper"] / letters),
            np.sqrt(c["n_bangs"] / words),
            np.sqrt(c["n_digits"] / inside),
            np.sqrt(c["n_stops"] / words),
            np.log((c["n_distinct"] + 1) / (words + 1)),
            np.sqrt(c["n_dup_lines"] / np.maximum(c["n_lines"], 1)),
            np.log1p(c["n_lines"]) - np.log1p(c["n_words"]),
        ],
        axis=1,
    )


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(stats.COUNTS))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


class Discriminant:
    """Fitted classes; margins and scores of feature rows."""

    def __init__(self, sums: dict[int, np.ndarray]) -> None:
        d = len(features(np.zeros((1, len(stats.COUNTS))))[0])
        self.classes, total = {}, sum(s[0] for s in sums.values())
        for label, s in sums.items():
            n, mean = s[0], s[1 : d + 1] / s[0]
            own = s[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
            own = (1 - SHRINKAGE) * own + SHRINKAGE * np.diag(np.diag(own)) + RIDGE * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.classes[label] = mean, np.linalg.inv(factor), np.log(np.diag(factor)).sum() - np.log(n / total)
        self.slope, self.shift = 1.0, 0.0

    def margin(self, rows: np.ndarray) -> np.ndarray:
        if self.classes.keys() != {0, 1}:
            return np.full(len(rows), {(0,): -np.inf, (1,): np.inf}.get(tuple(self.classes), 0.0))
        density = [-0.5 * (((rows - m) @ inverse.T) ** 2).sum(1) - rest for m, inverse, rest in (self.classes[0], self.classes[1])]
        return np.clip(density[1] - density[0], -REACH, REACH)

    def calibrate(self, histogram: dict[tuple[int, int], int]) -> None:
        """The logistic curve of the least log loss, with targets smoothed by one row of either class."""
        at = np.array([b for b, _ in histogram], float)
        label = np.array([y for _, y in histogram], float)
        n = np.array(list(histogram.values()), float)
        good, bad = (n * label).sum(), (n * (1 - label)).sum()
        target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        scale = 100.0
        x = np.stack([at / scale, np.ones(len(at))], 1)
        b = np.array([1.0, 0.0])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
            gradient = x.T @ (n * (p - target)) + 1e-3 * b
            curve = (x.T * (n * np.maximum(p * (1 - p), 1e-9))) @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(curve, gradient)
            b -= step * min(1, 2 / np.abs(step).max()) if np.abs(step).max() > 0 else 0
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = b[0] / scale, b[1]

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.classes.keys() != {0, 1}:
            return np.full(len(rows), {(0,): 0.0, (1,): 1.0}.get(tuple(self.classes), 0.5))
        return 1 / (1 + np.exp(-np.clip(self.margin(rows) * self.slope + self.shift, -500, 500)))


def fit(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Fit on the rows of counts that have a label and are not held out."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))
    rows = written(counts.where(~held_out(id_col)).join(known, F.col(id_col) == F.col("_id")).select("_label", "counts"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = features(matrix(b.column(1))), b.column(0).to_numpy()
            for label in np.unique(y):
                z = x[y == label]
                s = np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
                sums[int(label)] = sums.get(int(label), 0) + s
        for label, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([s], pa.list_(pa.float64()))], names=["label", "sums"])

    total = rows.mapInArrow(add, "label int, sums array<double>").select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("s"))
    by: dict[int, dict[int, float]] = {}
    for r in total.collect():
        by.setdefault(r["label"], {})[r["pos"]] = r["s"]
    model = Discriminant({y: np.array([s[k] for k in sorted(s)]) for y, s in sorted(by.items())})
    if model.classes.keys() == {0, 1}:

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.round(model.margin(features(matrix(b.column(1))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0)], names=["bin", "label"])

        found = rows.mapInArrow(bins, "bin int, label int").groupBy("bin", "label").count().collect()
        model.calibrate({(r["bin"], r["label"]): r["count"] for r in sorted(found)})
    return model


def score(counts: DataFrame, model: Discriminant, id_col: str = "doc_id", predict_at: float = PREDICT_AT) -> DataFrame:
    """(id, held_out, margin, score, predicted) of every row of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(matrix(b.column(1)))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.margin(x)), pa.array(s), pa.array((s >= predict_at).astype(np.int32))], names=["id", "margin", "score", "predicted"])

    kind = counts.schema[id_col].dataType.simpleString()
    got = counts.select(id_col, "counts").mapInArrow(run, f"id {kind}, margin double, score double, predicted int").withColumnRenamed("id", id_col)
    return got.select(id_col, held_out(id_col).alias("held_out"), "margin", "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Count every whole text once, fit on the labelled rows, score all."""
    counts = written(stats.counted(docs, id_col, text_col))
    return score(counts, fit(counts, labels, id_col, label_col), id_col)
