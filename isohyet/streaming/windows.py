"""Statistics of unbounded streams of cells: tumbling and sliding windows, and running means with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES = ["var", "level", "x", "y"]


def periods(cells: DataFrame, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Per series and window: count, sum, mean, minimum and maximum; steps later than *late* are let go.

    Windows begin at the epoch. Sliding windows take the place of running statistics where
    frames are spans of time.
    """
    window = F.window("t", length, slide) if slide else F.window("t", length)
    grouped = cells.withWatermark("t", late).groupBy(*SERIES, window.alias("w"))
    out = grouped.agg(F.count("v").alias("n"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    return out.select(*SERIES, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "sum", "mean", "min", "max")


def running_mean(cells: DataFrame, n: int) -> DataFrame:
    """Means over the last n steps of each series, in order of arrival; a series' state is n values."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            means, at = [], []
            for ts, v in zip(pdf["ts"], pdf["v"]):
                held = [*held, float(v)][-n:]
                if len(held) == n:
                    means.append(sum(held) / n)
                    at.append(ts)
            yield pd.DataFrame({"var": key[0], "level": key[1], "x": key[2], "y": key[3], "ts": at, "v": means})
        state.update((held,))

    return cells.groupBy(*SERIES).applyInPandasWithState(step, "var string, level double, x int, y int, ts int, v double", "held array<double>", "append", "NoTimeout")
