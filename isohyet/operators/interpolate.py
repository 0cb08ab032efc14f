"""Interpolation over time and levels, filling of gaps, smoothing, and surfaces of a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohyet.dataset import SERIES, Dataset
from isohyet.operators.modify import increment, shifted
from isohyet.operators.registry import op, put

V = F.col("v")


def blend(a: Column, b: Column, share: Column) -> Column:
    """a (1 - share) + b share; with one side missing, the other where it weighs half or more."""
    return F.when(a.isNotNull() & b.isNotNull(), a * (1 - share) + b * share).when(b.isNull() & (share <= 0.5), a).when(a.isNull() & (share >= 0.5), b)


def _steps_between(d: Dataset) -> DataFrame:
    """Each cell with the next step's value and time."""
    w = W.partitionBy(*SERIES).orderBy("ts")
    return d.cells.withColumns({"_v2": F.lead("v").over(w), "_t2": F.lead("t").over(w)})


@op("inttime")
def inttime(d: Dataset, date: str, time: str = "00:00:00", inc: str = "") -> Dataset:
    """Values at a start and every increment on, as far as the steps reach.

    Target times are made for each pair of neighbouring steps, from the pair's own bounds, so no
    range join is needed.
    """
    start = F.lit(f"{date} {time}").cast("timestamp")
    own = _steps_between(d)
    if not inc:
        at = own.where((F.col("t") == start) | ((F.col("t") < start) & (F.col("_t2") > start))).withColumn("_at", start).withColumn("_n", F.lit(0))
    else:
        n, unit = increment(inc)
        if unit == "second":
            step = n * 1_000_000
            micros = F.unix_micros("t") - F.unix_micros(start)
            first = F.greatest(F.ceil(micros / step), F.lit(0)).cast("long")
            last = F.coalesce(F.ceil((F.unix_micros("_t2") - F.unix_micros(start)) / step).cast("long") - 1, F.when(F.pmod(micros, F.lit(step)) == 0, first).otherwise(first - 1))
        else:
            months = lambda c: F.months_between(c, start) / n
            first = F.greatest(F.ceil(months(F.col("t"))), F.lit(0)).cast("long")
            last = F.coalesce(F.ceil(months(F.col("_t2"))).cast("long") - 1, F.when(months(F.col("t")) == first, first).otherwise(first - 1))
        at = own.withColumns({"_f": first, "_l": last}).where(F.col("_l") >= F.col("_f")).withColumn("_n", F.explode(F.sequence("_f", "_l"))).withColumn("_at", shifted(start, F.col("_n") * n, unit))
    share = (F.unix_micros("_at") - F.unix_micros("t")) / F.nullif(F.unix_micros("_t2") - F.unix_micros("t"), F.lit(0))
    value = F.when(F.col("_at") == F.col("t"), V).otherwise(blend(V, F.col("_v2"), share))
    return d.of(at.withColumn("v", value).withColumn("ts", F.col("_n")).withColumn("t", F.col("_at")))


@op("intntime")
def intntime(d: Dataset, n: int) -> Dataset:
    """n - 1 steps between each two."""
    n = int(n)
    own = _steps_between(d.dense())
    at = own.withColumn("_k", F.explode(F.when(F.col("_t2").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(n - 1)))))
    share = F.col("_k") / n
    t = F.timestamp_micros((F.unix_micros("t") + F.coalesce((F.unix_micros("_t2") - F.unix_micros("t")) * share, F.lit(0.0))).cast("long"))
    value = F.when(F.col("_k") == 0, V).otherwise(blend(V, F.col("_v2"), share))
    return d.of(at.withColumn("v", value).withColumn("t", t).withColumn("ts", F.col("ts") * n + F.col("_k")))


@op("intyear")
def intyear(a: Dataset, b: Dataset, *years: int) -> list[Dataset]:
    """For each year between those of two datasets: linear between equal months, days and times."""
    keys = [*SERIES, "_when"]
    when = F.date_format("t", "MM-dd HH:mm:ss")
    right = b.cells.withColumn("_when", when).select(*keys, F.col("v").alias("_v2"), F.year("t").alias("_y2"))
    both = a.cells.withColumn("_when", when).join(right, keys)
    out = []
    for y in map(int, years):
        share = (F.lit(y) - F.year("t")) / (F.col("_y2") - F.year("t"))
        t = shifted(F.col("t"), ((F.lit(y) - F.year("t")) * 12).cast("int"), "month")
        out.append(a.of(both.withColumn("v", V * (1 - share) + F.col("_v2") * share).withColumn("t", t)))
    return out


def _columns(d: Dataset) -> DataFrame:
    """Per variable, step and cell: the column of (level, v), by level."""
    return d.cells.groupBy("var", "ts", "t", "x", "y").agg(F.array_sort(F.collect_list(F.struct("level", "v"))).alias("_c"))


def _bracket(column: Column, z: Column, extrapolate: bool) -> Column:
    """Linear between the levels around z; missing outside, or the nearest level's value."""
    below = F.filter(column, lambda c: c["level"] <= z)
    above = F.filter(column, lambda c: c["level"] >= z)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    share = (z - a["level"]) / F.nullif(b["level"] - a["level"], F.lit(0.0))
    inside = F.when(a["level"] == z, a["v"]).otherwise(blend(a["v"], b["v"], share))
    if not extrapolate:
        return F.when((F.size(below) > 0) & (F.size(above) > 0), inside)
    return F.when(F.size(below) == 0, b["v"]).when(F.size(above) == 0, a["v"]).otherwise(inside)


def _to_levels(d: Dataset, levels: list[float], extrapolate: bool) -> Dataset:
    own = _columns(d).withColumn("_z", F.explode(F.array(*[F.lit(float(z)) for z in levels])))
    return d.of(own.withColumn("level", F.col("_z")).withColumn("v", _bracket(F.col("_c"), F.col("_z"), extrapolate))).with_(single=d.single - {"level"})


put("intlevel", lambda d, *z: _to_levels(d, [float(x) for x in z], False))
put("intlevelx", lambda d, *z: _to_levels(d, [float(x) for x in z], True))


def _to_field_levels(d: Dataset, heights: Dataset, target: Dataset | None, extrapolate: bool) -> Dataset:
    """Linear in a three-dimensional height: heights of the source levels, and of the target's."""
    h = heights.cells.select("level", "x", "y", F.col("v").alias("_h")).distinct()
    cols = d.cells.join(h, ["level", "x", "y"]).groupBy("var", "ts", "t", "x", "y").agg(F.array_sort(F.collect_list(F.struct(F.col("_h").alias("level"), "v"))).alias("_c"))
    z = target.cells.select("level", "x", "y", F.col("v").alias("_z")).distinct()
    return d.of(cols.join(z, ["x", "y"]).withColumn("v", _bracket(F.col("_c"), F.col("_z"), extrapolate)))


put("intlevel3d", lambda d, h, z: _to_field_levels(d, h, z, False), 3)
put("intlevelx3d", lambda d, h, z: _to_field_levels(d, h, z, True), 3)


@op("isosurface")
def isosurface(d: Dataset, value: float) -> Dataset:
    """The level, linear between two, at which a column first passes the value."""
    iso = F.lit(float(value))
    col = F.col("_c")
    pairs = F.zip_with(F.slice(col, 1, F.greatest(F.size(col) - 1, F.lit(0))), F.slice(col, 2, F.greatest(F.size(col), F.lit(1))), lambda a, b: F.struct(a["level"].alias("z1"), a["v"].alias("v1"), b["level"].alias("z2"), b["v"].alias("v2")))
    full = F.filter(pairs, lambda p: ((p["v1"] <= iso) & (p["v2"] >= iso)) | ((p["v1"] >= iso) & (p["v2"] <= iso)) | (p["v1"].isNotNull() & p["v2"].isNull() & (p["v1"] == iso)) | (p["v1"].isNull() & (p["v2"] == iso)))
    p = F.get(full, F.lit(0))
    at = F.when(p["v2"].isNull() | (p["v1"] == iso), p["z1"]).when(p["v1"].isNull() | (p["v1"] == p["v2"]), p["z2"]).otherwise(p["z1"] + (iso - p["v1"]) / (p["v2"] - p["v1"]) * (p["z2"] - p["z1"]))
    return d.of(_columns(d).withColumn("v", at).withColumn("level", F.lit(0.0))).only("level")


# Horizontal neighbours


@op("smooth9")
def smooth9(d: Dataset) -> Dataset:
    """Nine points, the centre 1, edges 0.5, corners 0.3, over the weights of those that are there.

    Every value goes to its neighbours, and is summed there by partial aggregates.
    """
    nx, ny = d.grid.nx, d.grid.ny
    moves = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit({0: 1.0, 1: 0.5, 2: 0.3}[abs(i) + abs(j)]).alias("w")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    own = d.cells.withColumn("_m", F.explode(moves))
    x, y = F.col("x") + F.col("_m.dx"), F.col("y") + F.col("_m.dy")
    x = F.pmod(x, F.lit(nx)) if d.grid.circular else x
    there = F.when(V.isNotNull(), F.col("_m.w"))
    out = own.select("var", "level", "ts", "t", x.cast("int").alias("x"), y.cast("int").alias("y"), (V * F.col("_m.w")).alias("_s"), there.alias("_w"), F.when((F.col("_m.dx") == 0) & (F.col("_m.dy") == 0), 1).alias("_own"))
    out = out.where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1)).groupBy("var", "level", "ts", "x", "y").agg((F.sum("_s") / F.sum("_w")).alias("v"), F.max("t").alias("t"), F.max("_own").alias("_own"))
    return d.of(out.where("_own = 1"))


def _nearest_along(d: Dataset, axis: str, circular: bool) -> dict[str, Column]:
    """The nearest value on either side along an axis, and how far off it is."""
    other = "y" if axis == "x" else "x"
    w = W.partitionBy("var", "level", "ts", other).orderBy(axis)
    full = F.when(V.isNotNull(), F.struct(F.col(axis).alias("at"), V.alias("v")))
    before, after = F.last(full, True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first(full, True).over(w.rowsBetween(1, W.unboundedFollowing))
    if not circular:
        return {"before": before, "after": after}
    n, every = d.grid.nx, W.partitionBy("var", "level", "ts", other).orderBy(axis).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last, first = F.last(full, True).over(every), F.first(full, True).over(every)
    return {
        "before": F.coalesce(before, F.struct((last["at"] - n).alias("at"), last["v"].alias("v"))),
        "after": F.coalesce(after, F.struct((first["at"] + n).alias("at"), first["v"].alias("v"))),
    }


def _sides(d: Dataset, circular: bool) -> DataFrame:
    """The cells with _xbefore, _xafter, _ybefore and _yafter, the nearest values (at, v) on every side."""
    sides = {}
    for axis in ("x", "y"):
        for side, c in _nearest_along(d, axis, circular and axis == "x").items():
            sides[f"_{axis}{side}"] = c
    return d.cells.withColumns(sides)


@op("fillmiss")
def fillmiss(d: Dataset, least: int = 1) -> Dataset:
    """Linear along x and along y between the nearest values, where *least* sides have one.

    The two are weighted crosswise: each by the number of sides that the other has.
    """
    own = _sides(d, d.grid.circular)

    def along(axis: str) -> tuple[Column, Column]:
        a, b, here = F.col(f"_{axis}before"), F.col(f"_{axis}after"), F.col(axis)
        between = (a["v"] * (b["at"] - here) + b["v"] * (here - a["at"])) / (b["at"] - a["at"])
        return F.coalesce(between, a["v"], b["v"]), a["v"].isNotNull().cast("int") + b["v"].isNotNull().cast("int")

    (vx, nx), (vy, ny) = along("x"), along("y")
    mixed = F.coalesce((vx * ny + vy * nx) / (nx + ny), vx, vy)
    return d.of(own.withColumn("v", F.when(V.isNotNull(), V).when(nx + ny >= int(least), mixed)))


@op("fillmiss2")
def fillmiss2(d: Dataset, rounds: int = 1) -> Dataset:
    """The one nearest value along x or y, in a number of rounds; of equally far ones the right, the upper, and x before y."""
    for _ in range(int(rounds)):
        own = _sides(d, False)

        def candidate(axis: str, side: str, order: int) -> Column:
            c = F.col(f"_{axis}{side}")
            return F.when(c["v"].isNotNull(), F.struct(F.abs(c["at"] - F.col(axis)).alias("off"), F.lit(order).alias("order"), c["v"].alias("v")))

        nearest = F.least(candidate("x", "after", 0), candidate("x", "before", 1), candidate("y", "before", 2), candidate("y", "after", 3))
        d = d.of(own.withColumn("v", F.coalesce(V, nearest["v"])))
    return d
