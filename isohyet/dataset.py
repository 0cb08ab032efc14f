"""Datasets: long rows of (var, level, ts, t, x, y, v) with small descriptions beside them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.grid import Grid

COLUMNS = ["var", "level", "ts", "t", "x", "y", "v"]
SERIES = ["var", "level", "x", "y"]
TIE = 3.1e-7
FIELD = ["var", "level", "ts", "t"]


@dataclass(frozen=True)
class Dataset:
    """cells: a row for each value. ts orders the steps and need not be without gaps; v is null where missing.

    variables: name to its metadata (code, param, stdname, longname, units, tabnum, ltype).
    """

    cells: DataFrame
    grid: Grid
    variables: dict[str, dict] = field(default_factory=dict)
    attrs: dict[str, str] = field(default_factory=dict)
    calendar: str = "standard"
    vct: tuple[float, ...] = ()
    #: Which of var, level and ts are known to have one value only.
    single: frozenset[str] = frozenset()

    def with_(self, **changes: object) -> Dataset:
        return replace(self, **changes)

    def of(self, cells: DataFrame, **changes: object) -> Dataset:
        return replace(self, cells=cells.select(*COLUMNS), **changes)

    def map(self, v: Column) -> Dataset:
        """Every value replaced by an expression of the row's columns; no shuffle."""
        return self.of(self.cells.withColumn("v", v.cast("double")))

    def where(self, condition: Column) -> Dataset:
        return self.of(self.cells.where(condition))

    def table(self) -> DataFrame:
        """Result rows without the time stamp, rounded, for comparison; TIE moves decimal ties off the boundary."""
        return self.cells.select("var", F.col("level").cast("double").alias("level"), F.col("ts").cast("long").alias("ts"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.round(F.col("v") + TIE, 4).alias("v"))

    def lon(self) -> Column:
        return self.grid.lon()

    def lat(self) -> Column:
        return self.grid.lat()

    def only(self, *names: str) -> Dataset:
        return replace(self, single=self.single | set(names))

    def measured(self) -> Dataset:
        """The dataset with ``single`` looked up in the data."""
        return self.only(*[c for c in ("var", "level", "ts") if len(self.cells.select(c).distinct().limit(2).collect()) < 2])

    def steps(self) -> DataFrame:
        """The time axis: (ts, t), one row a step."""
        return self.cells.groupBy("ts").agg(F.max("t").alias("t"))

    def dense(self) -> Dataset:
        """The same steps numbered 0, 1, 2 ...; the time axis is small beside the cells."""
        from pyspark.sql import Window as W

        axis = self.steps().select("ts", (F.row_number().over(W.orderBy("ts")) - 1).cast("int").alias("_n"))
        return self.of(self.cells.join(axis, "ts").withColumn("ts", F.col("_n")))

    def __getattr__(self, name: str) -> Callable[..., object]:
        from isohyet.operators import registry

        if name.startswith("__") or not registry.known(name):
            raise AttributeError(name)
        return lambda *args: registry.apply(name, [self], *args)


def apply_in_groups(cells: DataFrame, keys: list[str | Column], f: Callable, more: str = "") -> DataFrame:
    """Groups of cells as pandas frames through *f*; t is in microseconds there, as pandas' time stamps end in 2262."""
    kinds = f"var string, level double, ts long, t long, x int, y int, v double{more}"
    return cells.withColumn("t", F.unix_micros("t")).groupBy(*keys).applyInPandas(f, kinds).withColumn("t", F.timestamp_micros("t"))


def union(datasets: list[Dataset]) -> DataFrame:
    out = datasets[0].cells.select(*COLUMNS)
    for d in datasets[1:]:
        out = out.unionByName(d.cells.select(*COLUMNS))
    return out
