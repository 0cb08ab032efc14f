"""What a dataset holds: per-field statistics, counts and lists, comparison of two datasets. Results are DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohyet.dataset import Dataset
from isohyet.operators.registry import op, put

V, T = F.col("v"), F.col("t")


def _label(d: Dataset, key: str) -> Column:
    out = F.col("var")
    for n, m in d.variables.items():
        if key != "name" and key in m:
            out = F.when(F.col("var") == n, F.lit(str(m[key]))).otherwise(out)
    return out


def info(d: Dataset, key: str) -> DataFrame:
    """Per field: size, missing values, minimum, unweighted mean, maximum."""
    out = d.cells.groupBy("var", "level", "ts", "t").agg(F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) - F.count(V)).alias("missing"), F.min(V).alias("minimum"), F.avg(V).alias("mean"), F.max(V).alias("maximum"))
    return out.withColumn("label", _label(d, key))


for _n, _k in (("info", "param"), ("infop", "param"), ("infon", "name"), ("infoc", "code"), ("pinfo", "param"), ("pinfov", "name")):
    put(_n, lambda d, k=_k: info(d, k))


@op("map")
def map_(d: Dataset) -> DataFrame:
    """Info, with each row of a field drawn: 0 to 9 from its minimum to its maximum, - where missing."""
    w = W.partitionBy("var", "level", "ts")
    low, high = F.min(V).over(w), F.max(V).over(w)
    digit = F.when(V.isNull(), "-").otherwise(F.least(F.floor((V - low) * 10 / F.nullif(high - low, F.lit(0.0))), F.lit(9)).cast("string"))
    rows = d.cells.withColumn("_c", F.coalesce(digit, F.lit("0"))).groupBy("var", "level", "ts", "y").agg(F.array_sort(F.collect_list(F.struct("x", "_c"))).alias("_r"))
    return rows.select("var", "level", "ts", "y", F.concat_ws("", F.transform("_r", lambda r: r["_c"])).alias("row"))


def sinfo(d: Dataset, key: str) -> DataFrame:
    """Per variable: levels, steps, cells, first and last time."""
    out = d.cells.groupBy("var").agg(F.countDistinct("level").alias("levels"), F.countDistinct("ts").alias("steps"), F.lit(d.grid.size).alias("cells"), F.min("t").alias("first"), F.max("t").alias("last"))
    return out.withColumn("label", _label(d, key)).withColumn("grid", F.lit(d.grid.kind))


for _e in ("", "e"):
    for _n, _k in (("", "param"), ("p", "param"), ("n", "name"), ("c", "code")):
        put(f"s{_e}info{_n}", lambda d, k=_k: sinfo(d, k))


@op("tinfo")
def tinfo(d: Dataset) -> DataFrame:
    """Per step: its time and the seconds since the step before."""
    w = W.orderBy("ts")
    return d.steps().select("ts", "t", (F.unix_timestamp("t") - F.unix_timestamp(F.lag("t").over(w))).alias("seconds"))


def diff(a: Dataset, b: Dataset, limit: float = 0.0) -> DataFrame:
    """Fields that differ: cells that do, greatest absolute and relative difference, sign change, zeros."""
    keys = ["var", "level", "ts", "x", "y"]
    both = a.cells.select(*keys, "v").join(b.cells.select(*keys, F.col("v").alias("w")), keys, "full")
    w = F.col("w")
    gap, top = F.abs(V - w), F.greatest(F.abs(V), F.abs(w))
    one = V.isNull() != w.isNull()
    differs = one | (gap > float(limit))
    out = both.groupBy("var", "level", "ts").agg(
        F.count(F.when(differs, 1)).alias("differing"),
        F.max(gap).alias("largest"),
        F.max(F.when(one, 1.0).when(V * w < 0, 1.0).when(top > 0, gap / top)).alias("relative"),
        F.coalesce(F.bool_or(V * w < 0), F.lit(False)).alias("sign"),
        F.coalesce(F.bool_or(V * w == 0), F.lit(False)).alias("zero"),
    )
    return out.where("differing > 0")


for _n in ("diff", "diffp", "diffn", "diffc"):
    put(_n, diff, 2)


def _changes(d: Dataset, value: Column) -> DataFrame:
    """How often a value changes along the time axis, plus one."""
    axis = d.steps().select("ts", value.alias("k"))
    return axis.select((F.col("k") != F.lag("k").over(W.orderBy("ts"))).cast("long").alias("c")).agg((F.coalesce(F.sum("c"), F.lit(0)) + 1).alias("n"))


put("nyear", lambda d: _changes(d, F.year(T)))
put("nmon", lambda d: _changes(d, F.month(T)))
put("ndate", lambda d: _changes(d, F.to_date(T)))
put("ntime", lambda d: d.cells.agg(F.countDistinct("ts").alias("n")))
put("npar", lambda d: d.cells.agg(F.countDistinct("var").alias("n")))
put("nlevel", lambda d: d.cells.groupBy("var").agg(F.countDistinct("level").alias("n")))


def _listed(d: Dataset, value: Column) -> DataFrame:
    """Distinct values in order of the first step that has them."""
    return d.steps().groupBy(value.alias("value")).agg(F.min("ts").alias("first")).orderBy("first").select("value", "first")


put("showyear", lambda d: _listed(d, F.year(T)))
put("showmon", lambda d: _listed(d, F.month(T)))
put("showdate", lambda d: _listed(d, F.date_format(T, "yyyy-MM-dd")))
put("showtime", lambda d: _listed(d, F.date_format(T, "HH:mm:ss")))
put("showtimestamp", lambda d: _listed(d, F.date_format(T, "yyyy-MM-dd'T'HH:mm:ss")))
put("showname", lambda d: d.cells.select(F.col("var").alias("value")).distinct())
for _k in ("code", "param", "unit", "stdname", "ltype"):
    put(f"show{_k}", lambda d, k=_k: d.cells.select("var").distinct().select("var", F.when(F.col("var").isin([n for n, m in d.variables.items() if k in m]), _label(d, k)).alias("value")))
put("showlevel", lambda d: d.cells.select("var", "level").distinct())


def _rows(d: Dataset, rows: list[tuple], schema: str) -> DataFrame:
    return d.cells.sparkSession.createDataFrame(rows, schema)


put("showformat", lambda d: _rows(d, [(d.attrs.get("format", "parquet"),)], "value string"))
for _n in ("griddes", "griddes2", "writegrid"):
    put(_n, lambda d: _rows(d, [(y * d.grid.nx + x, x, y, float(d.grid.lons[x]), float(d.grid.lats[y]), d.grid.area(x, y)) for y in range(d.grid.ny) for x in range(d.grid.nx)], "cell int, x int, y int, lon double, lat double, area double"))
put("zaxisdes", lambda d: d.cells.select("var", "level").distinct())
for _n in ("vct", "vct2"):
    put(_n, lambda d: _rows(d, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(d.vct[: len(d.vct) // 2], d.vct[len(d.vct) // 2 :]))], "k int, a double, b double"))
for _n in ("pardes", "partab", "partab2", "spartab", "vlist"):
    put(_n, lambda d: _rows(d, [(n, *(str(m[k]) if k in m else None for k in ("code", "param", "stdname", "longname", "unit"))) for n, m in d.variables.items()], "name string, code string, param string, stdname string, longname string, unit string"))
put("filedes", lambda d: _rows(d, sorted((k, str(v)) for k, v in d.attrs.items()), "name string, value string"))


@op("specinfo", inputs=0)
def specinfo(resolution: str) -> dict[str, int]:
    """Sizes that belong to a spectral truncation (t21) or a number of latitudes (n16)."""
    kind, n = resolution[0].lower(), int(resolution.strip("tlnTLN"))
    if kind == "n":
        half, truncation = n, (4 * n - 1) // 3
    else:
        truncation, half = n, (3 * n + 1 + 3) // 4
    return {"truncation": truncation, "latitudes": 2 * half, "longitudes": 4 * half, "coefficients": (truncation + 1) * (truncation + 2)}
