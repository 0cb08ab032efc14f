"""Remapping: weights of (source cell, target cell), and their sparse product with the fields.

Weights belong to a pair of grids, which are described on the driver; they are made there as
well, and their number is that of the target's cells times the links of each. Applied, they
are broadcast up to ``BROADCAST_LINKS``, and joined by source cell beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.dataset import Dataset
from isohyet.grid import Grid
from isohyet.operators.modify import as_grid
from isohyet.operators.registry import op, put
from isohyet.operators.weights import METHODS, Links, conservative

BROADCAST_LINKS = 2_000_000


def table(spark: SparkSession, links: Links) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"src": links[0].astype("int32"), "dst": links[1].astype("int32"), "w": links[2].astype(float)}), "src int, dst int, w double")


def apply(d: Dataset, weights: DataFrame, dst: Grid, small: bool, value: object = None) -> Dataset:
    """Sums of weighted values by target cell. Weights of missing sources are made up for by the others."""
    own = d.cells.withColumn("src", (F.col("y") * d.grid.nx + F.col("x")).cast("int")).join(F.broadcast(weights) if small else weights, "src")
    there = F.when(F.col("v").isNotNull(), F.col("w"))
    v = F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum(there), F.lit(0.0)) if value is None else value
    out = own.groupBy("var", "level", "ts", "t", "dst").agg(v.alias("v"))
    return d.of(out.withColumns({"x": (F.col("dst") % dst.nx).cast("int"), "y": F.floor(F.col("dst") / dst.nx).cast("int")}), grid=dst)


def remapped(d: Dataset, grid: Grid | str, method: str) -> Dataset:
    dst = as_grid(grid)
    links = METHODS[method](d.grid, dst)
    return apply(d, table(d.cells.sparkSession, links), dst, len(links[0]) <= BROADCAST_LINKS)


for _m in METHODS:
    put(f"remap{_m}", lambda d, grid, m=_m: remapped(d, grid, m))
    put(f"gen{_m}", lambda d, grid, m=_m: table(d.cells.sparkSession, METHODS[m](d.grid, as_grid(grid))))


@op("remap")
def remap(d: Dataset, grid: Grid | str, weights: DataFrame | str) -> Dataset:
    """With weights made before: a table of (src, dst, w), or its path."""
    w = d.cells.sparkSession.read.parquet(weights) if isinstance(weights, str) else weights
    return apply(d, w, as_grid(grid), False)


@op("remapsum")
def remapsum(d: Dataset, grid: Grid | str) -> Dataset:
    """Sums are kept: each source value is shared out by the part of its cell that a target covers."""
    dst = as_grid(grid)
    s, t, w = conservative(dst, d.grid, "dest")
    return apply(d, table(d.cells.sparkSession, (t, s, w)), dst, len(s) <= BROADCAST_LINKS, F.sum(F.col("w") * F.col("v")))


put("intgridbil", lambda d, grid: remapped(d, grid, "bil"))
put("intgridcon", lambda d, grid: remapped(d, grid, "con"))
put("interpolate", lambda d, grid: remapped(d, grid, "bil"))
put("yarbil", lambda d, grid: remapped(d, grid, "bil"))
put("yarcon", lambda d, grid: remapped(d, grid, "con"))
put("intpoint", lambda d, lon, lat: remapped(d, Grid((float(lon),), (float(lat),)), "bil"))


@op("boxavg")
def boxavg(d: Dataset, nx: int, ny: int) -> Dataset:
    from isohyet.operators.stats import STATS, over_boxes

    return over_boxes(d, STATS["mean"], nx, ny)


@op("thinout")
def thinout(d: Dataset, nx: int, ny: int) -> Dataset:
    nx, ny = int(nx), int(ny)
    own = d.where((F.col("x") % nx == 0) & (F.col("y") % ny == 0))
    return own.of(own.cells.withColumns({"x": F.floor(F.col("x") / nx).cast("int"), "y": F.floor(F.col("y") / ny).cast("int")}), grid=d.grid.with_(lons=d.grid.lons[::nx], lats=d.grid.lats[::ny], mask=None, areas=None))


@op("intgridtraj")
def intgridtraj(d: Dataset, path: DataFrame) -> Dataset:
    """Along a path of (t, lon, lat): bilinear in space, linear in time between the steps around.

    The four corners are found per point by arithmetic on the regular coordinates, steps by
    the time axis, so that all joins are by equality.
    """
    from pyspark.sql import Window as W

    g = d.grid
    dx = (g.lons[-1] - g.lons[0]) / max(1, g.nx - 1) or 1.0
    dy = (g.lats[-1] - g.lats[0]) / max(1, g.ny - 1) or 1.0
    fx, fy = F.pmod(F.col("lon") - g.lons[0], F.lit(360.0)) / dx if g.circular else (F.col("lon") - g.lons[0]) / dx, (F.col("lat") - g.lats[0]) / dy
    axis = d.steps().select(F.col("t").alias("t1"), F.col("ts").alias("ts1"), F.lead("t").over(W.orderBy("ts")).alias("t2"), F.lead("ts").over(W.orderBy("ts")).alias("ts2"))
    marks = path.select("t", "lon", "lat", F.lit(None).cast("timestamp").alias("t1"), F.lit(None).cast("long").alias("ts1"), F.lit(None).cast("timestamp").alias("t2"), F.lit(None).cast("long").alias("ts2"), F.lit(1).alias("_o"))
    both = marks.unionByName(axis.select(F.col("t1").alias("t"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), "t1", F.col("ts1").cast("long"), "t2", F.col("ts2").cast("long"), F.lit(0).alias("_o")))
    w = W.orderBy("t", "_o").rowsBetween(W.unboundedPreceding, 0)
    placed = both.select("t", "lon", "lat", "_o", *[F.last(c, True).over(w).alias(c) for c in ("t1", "ts1", "t2", "ts2")]).where("_o = 1 AND t1 IS NOT NULL")
    share = F.coalesce((F.unix_micros("t") - F.unix_micros("t1")) / F.nullif(F.unix_micros("t2") - F.unix_micros("t1"), F.lit(0)), F.lit(0.0))
    i, j = F.floor(fx).cast("int"), F.floor(fy).cast("int")
    px, py = fx - F.floor(fx), fy - F.floor(fy)
    corners = F.array(*[F.struct((F.pmod(i + a, F.lit(g.nx)) if g.circular else F.least(i + a, F.lit(g.nx - 1))).alias("x"), F.least(j + b, F.lit(g.ny - 1)).alias("y"), ((px if a else 1 - px) * (py if b else 1 - py)).alias("p")) for a in (0, 1) for b in (0, 1)])
    links = placed.withColumn("_c", F.explode(corners)).withColumn("_s", F.explode(F.array(F.struct(F.col("ts1").alias("ts"), (1 - share).alias("q")), F.struct(F.col("ts2").alias("ts"), share.alias("q")))))
    links = links.select("t", "lon", "lat", "_c.x", "_c.y", "_s.ts", (F.col("_c.p") * F.col("_s.q")).alias("w")).where("w > 0")
    hit = d.cells.drop("t").join(links, ["ts", "x", "y"])
    out = hit.groupBy("var", "level", "t").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum(F.when(F.col("v").isNotNull(), F.col("w"))), F.lit(0.0))).alias("v"))
    return d.of(out.withColumns({"x": F.lit(0), "y": F.lit(0), "ts": F.unix_timestamp("t")}), grid=Grid((0.0,), (0.0,)))
