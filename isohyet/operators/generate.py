"""Datasets made from nothing, and the geometry of grids."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from isohyet.dataset import Dataset
from isohyet.grid import EARTH_RADIUS, Grid
from isohyet.operators.modify import as_grid
from isohyet.operators.registry import op, put

START = "1970-01-01"


def made(spark: SparkSession, grid: Grid, v: Column, name: str) -> Dataset:
    cells = spark.range(grid.size).select(
        F.lit(name).alias("var"),
        F.lit(0.0).alias("level"),
        F.lit(0).alias("ts"),
        F.lit(START).cast("timestamp").alias("t"),
        (F.col("id") % grid.nx).cast("int").alias("x"),
        F.floor(F.col("id") / grid.nx).cast("int").alias("y"),
    )
    return Dataset(cells.withColumn("v", v.cast("double")), grid, {name: {}}, single=frozenset({"var", "level", "ts"}))


@op("random", inputs=0)
def random(spark: SparkSession, grid: Grid | str, seed: int = 1) -> Dataset:
    return made(spark, as_grid(grid), F.rand(int(seed)), "random")


@op("const", inputs=0)
def const(spark: SparkSession, c: float, grid: Grid | str) -> Dataset:
    return made(spark, as_grid(grid), F.lit(float(c)), "const")


@op("sincos", inputs=0)
def sincos(spark: SparkSession, grid: Grid | str) -> Dataset:
    g = as_grid(grid)
    return made(spark, g, F.cos(F.radians(g.lon())) * F.sin(2 * F.radians(g.lat())), "sincos")


@op("coshill", inputs=0)
def coshill(spark: SparkSession, grid: Grid | str) -> Dataset:
    g = as_grid(grid)
    arc = F.acos(F.least(F.greatest(F.cos(F.radians(g.lon())) * F.cos(F.radians(g.lat())), F.lit(-1.0)), F.lit(1.0)))
    return made(spark, g, 2 - F.cos(arc / 1.2), "coshill")


@op("for", inputs=0)
def for_(spark: SparkSession, start: float, end: float, inc: float = 1.0) -> Dataset:
    """A series of one cell: start, start + inc, ... up to end, a day apart."""
    start, end, inc = float(start), float(end), float(inc)
    n = int((end - start) / inc + 1e-9) + 1
    cells = spark.range(n).select(
        F.lit("for").alias("var"),
        F.lit(0.0).alias("level"),
        F.col("id").cast("int").alias("ts"),
        F.timestamp_seconds(F.col("id") * 86400).alias("t"),
        F.lit(0).alias("x"),
        F.lit(0).alias("y"),
        (F.lit(start) + F.col("id") * inc).alias("v"),
    )
    return Dataset(cells, Grid((0.0,), (0.0,)), {"for": {}}, single=frozenset({"var", "level"}))


@op("stdatm", inputs=0)
def stdatm(spark: SparkSession, *levels: float) -> Dataset:
    """Pressure (hPa) and temperature (K) of a hydrostatic atmosphere at heights in metres.

    T = 213 + 75 exp(-h / 10000); the pressure follows by integrating g / (R T) over height.
    """
    g, r, p0, t0, dt, scale = 9.80665, 287.05, 1013.25, 213.0, 75.0, 10000.0
    z = F.col("level")
    temperature = t0 + dt * F.exp(-z / scale)
    pressure = p0 * F.exp(-(g * scale) / (r * t0) * F.log((F.exp(z / scale) * t0 + dt) / (t0 + dt)))
    rows = spark.createDataFrame([(float(h),) for h in levels], "level double")
    both = rows.select("level", F.explode(F.array(F.struct(F.lit("P").alias("var"), pressure.alias("v")), F.struct(F.lit("T").alias("var"), temperature.alias("v")))).alias("p"))
    cells = both.select("p.var", "level", F.lit(0).alias("ts"), F.lit(START).cast("timestamp").alias("t"), F.lit(0).alias("x"), F.lit(0).alias("y"), "p.v")
    return Dataset(cells, Grid((0.0,), (0.0,)), {"P": {}, "T": {}}, single=frozenset({"ts"}))


def _static(name: str) -> None:
    def run(spark: SparkSession, path: str) -> Dataset:
        """A half-degree global field from a table of (x, y, v) that the user supplies."""
        grid = as_grid("global_.5")
        cells = spark.read.parquet(path).select(F.lit(name).alias("var"), F.lit(0.0).alias("level"), F.lit(0).alias("ts"), F.lit(START).cast("timestamp").alias("t"), "x", "y", "v")
        return Dataset(cells, grid, {name: {}}, single=frozenset({"var", "level", "ts"}))

    put(name, run, 0)


for _n in ("topo", "temp", "mask"):
    _static(_n)


@op("cdiwrite", inputs=0)
def cdiwrite(spark: SparkSession, runs: int = 1, grid: Grid | str = "global_10", steps: int = 3, variables: int = 3, levels: int = 3) -> Dataset:
    """Synthetic data of a number of steps, variables and levels."""
    g = as_grid(grid)
    n = int(steps) * int(variables) * int(levels) * g.size
    i = F.col("id")
    cells = spark.range(n).select(
        F.concat(F.lit("var"), (F.floor(i / g.size / int(levels)) % int(variables) + 1).cast("string")).alias("var"),
        (F.floor(i / g.size) % int(levels) + 1).cast("double").alias("level"),
        F.floor(i / g.size / int(levels) / int(variables)).cast("int").alias("ts"),
        F.timestamp_seconds(F.floor(i / g.size / int(levels) / int(variables)) * 86400).alias("t"),
        (i % g.nx).cast("int").alias("x"),
        (F.floor(i / g.nx) % g.ny).cast("int").alias("y"),
        F.rand(1).alias("v"),
    )
    return Dataset(cells, g, {f"var{k + 1}": {} for k in range(int(variables))})


def _geometry(d: Dataset, values: list[float], name: str) -> Dataset:
    v = F.element_at(F.lit(values), (F.col("y") + 1).cast("int"))
    return made(d.cells.sparkSession, d.grid, v, name)


@op("gridarea")
def gridarea(d: Dataset, radius: float = EARTH_RADIUS) -> Dataset:
    return _geometry(d, d.grid.row_areas(float(radius)), "cell_area")


@op("gridweights")
def gridweights(d: Dataset) -> Dataset:
    return _geometry(d, d.grid.row_weights(), "cell_weights")


@op("gridmask")
def gridmask(d: Dataset) -> Dataset:
    mask = d.grid.mask or (1,) * d.grid.size
    return made(d.cells.sparkSession, d.grid, F.element_at(F.lit([float(m) for m in mask]), (F.col("y") * d.grid.nx + F.col("x") + 1).cast("int")), "grid_mask")


@op("griddx")
def griddx(d: Dataset) -> Dataset:
    """East-west extent of a cell: half the great-circle distance between its neighbours' centres."""
    from isohyet.grid import _arc, _unit

    step = abs(d.grid.lons[1] - d.grid.lons[0]) if d.grid.nx > 1 else 360.0
    return _geometry(d, [_arc(_unit(0, b), _unit(step, b)) * EARTH_RADIUS for b in d.grid.lats], "dx")


@op("griddy")
def griddy(d: Dataset) -> Dataset:
    """North-south extent of a cell: half the great-circle distance between its neighbours' centres."""
    from isohyet.grid import _arc, _unit

    lats = d.grid.lats
    gap = lambda i, j: _arc(_unit(0, lats[i]), _unit(0, lats[j])) * EARTH_RADIUS
    last = len(lats) - 1
    return _geometry(d, [gap(max(0, j - 1), min(last, j + 1)) / (2 if 0 < j < last else 1) for j in range(len(lats))] if last else [EARTH_RADIUS * 3.141592653589793], "dy")
