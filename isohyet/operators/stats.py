"""Statistics over time, space, levels and periods: one partial and one final aggregate each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.dataset import FIELD, SERIES, Dataset
from isohyet.operators.registry import op, put

V = F.col("v")


def strict(value: Column) -> Column:
    """Missing as soon as one input is."""
    return F.when(F.count(V) == F.count(F.lit(1)), value)


STATS: dict[str, Column] = {
    "min": F.min(V),
    "max": F.max(V),
    "range": F.max(V) - F.min(V),
    "sum": F.sum(V),
    "mean": F.avg(V),
    "avg": strict(F.avg(V)),
    "var": F.var_pop(V),
    "var1": F.var_samp(V),
    "std": F.stddev_pop(V),
    "std1": F.stddev_samp(V),
}
TIME_STATS = ["min", "max", "sum", "mean", "avg", "var", "var1", "std", "std1"]


def weighted(name: str, w: Column) -> Column:
    """A statistic with weights; min, max, sum and range have none."""
    own = F.when(V.isNotNull(), w)
    sw, swv, swvv, sww = F.sum(own), F.sum(own * V), F.sum(own * V * V), F.sum(own * own)
    clean = lambda q: F.when(q >= 0, q).when(q > -1e-5, F.lit(0.0))
    var = clean((swvv * sw - swv * swv) / F.nullif(sw * sw, F.lit(0.0)))
    var1 = clean((swvv * sw - swv * swv) / F.nullif(sw * sw - sww, F.lit(0.0)))
    own_stats = {"mean": swv / F.nullif(sw, F.lit(0.0)), "avg": strict(swv / F.nullif(sw, F.lit(0.0))), "var": var, "var1": var1, "std": F.sqrt(var), "std1": F.sqrt(var1)}
    return own_stats.get(name, STATS.get(name))


def percentile(p: float) -> Column:
    """Nearest rank: element ceil(n p / 100) of the sorted values."""
    p = min(100.0, max(0.0, float(p)))
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY v)")


def count() -> Column:
    return F.nullif(F.count(V), F.lit(0)).cast("double")


#: Ordering number of the period of a time stamp.
KEYS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "mon": lambda t: F.year(t) * 12 + F.month(t) - 1,
    "day": lambda t: F.datediff(t, F.lit("1970-01-01")),
    "hour": lambda t: F.floor(F.unix_timestamp(t) / 3600).cast("long"),
    "seas": lambda t: (F.year(t) + (F.month(t) == 12).cast("int")) * 4 + F.floor(F.month(t) % 12 / 3).cast("int"),
    "ymon": F.month,
    "yday": lambda t: (F.month(t) - 1) * 31 + F.day(t),
    "yhour": lambda t: ((F.month(t) - 1) * 31 + F.day(t)) * 25 + F.hour(t),
    "yseas": lambda t: F.floor(F.month(t) % 12 / 3).cast("int"),
}


def season_key(start: str = "DEC") -> Callable[[Column], Column]:
    """Seasons that begin in December, or with January."""
    return KEYS["seas"] if start == "DEC" else lambda t: F.year(t) * 4 + F.floor((F.month(t) - 1) / 3).cast("int")


def middle(first: Column, last: Column) -> Column:
    """The time halfway between two stamps."""
    return F.timestamp_seconds((F.unix_micros(first) + F.unix_micros(last)) / F.lit(2e6))


def over_periods(d: Dataset, key: Column, value: Column, stamp: str = "middle") -> Dataset:
    """A statistic of each series for each period; ts becomes the period's number."""
    t = {"middle": middle(F.min("t"), F.max("t")), "last": F.max("t"), "first": F.min("t")}[stamp]
    out = d.cells.withColumn("_p", key.cast("long")).groupBy(*SERIES, "_p").agg(value.alias("v"), t.alias("t"))
    return d.of(out.withColumn("v", F.col("v").cast("double")).withColumn("ts", F.col("_p")))


def over_time(d: Dataset, value: Column) -> Dataset:
    return over_periods(d, F.lit(0), value).only("ts")


def _periods(name: str, stat: str) -> Callable:
    stamp = "last" if name.startswith("y") and name != "year" else "middle"

    def run(d: Dataset, vfrac: float | None = None) -> Dataset:
        """vfrac: a mean is missing where fewer values than this share are there."""
        value = STATS[stat]
        if vfrac is not None:
            value = F.when(F.count(V) >= float(vfrac) * F.count(F.lit(1)), value)
        return over_periods(d, KEYS[name](F.col("t")), value, stamp)

    return run


for _s in TIME_STATS:
    put(f"tim{_s}", lambda d, vfrac=None, s=_s: over_time(d, STATS[s] if vfrac is None else F.when(F.count(V) >= float(vfrac) * F.count(F.lit(1)), STATS[s])))
    for _p in KEYS:
        put(f"{_p}{_s}", _periods(_p, _s))
for _p in KEYS:
    put(f"{_p}pctl", lambda d, p, *bounds, k=_p: percentiles(d, KEYS[k](F.col("t")), p, *bounds))
    if not _p.startswith("y") or _p == "year":
        put(f"{_p}count", lambda d, k=_p: over_periods(d, KEYS[k](F.col("t")), count()))
put("timcount", lambda d: over_time(d, count()))
put("timpctl", lambda d, p, *bounds: percentiles(d, F.lit(0), p, *bounds).only("ts"))


def percentiles(d: Dataset, key: Column, p: float, *bounds: Dataset) -> Dataset:
    """Exact nearest rank; with bounds (datasets of minima and maxima) the histogram's answer instead."""
    if len([b for b in bounds if isinstance(b, Dataset)]) < 2:
        return over_periods(d, key, percentile(p))
    return histogram_percentiles(d, key, p, *bounds)


def histogram_percentiles(d: Dataset, key: Column, p: float, low: Dataset, high: Dataset, bins: int = 101) -> Dataset:
    """Up to half of *bins* values exactly, beyond that linear within the bin that holds the rank."""
    same = [*SERIES]
    lo = low.cells.groupBy(*same).agg(F.min("v").alias("_lo"))
    hi = high.cells.groupBy(*same).agg(F.max("v").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    own = d.cells.withColumn("_p", key.cast("long")).join(lo, same).join(hi, same).where(V.isNotNull() & (F.col("_hi") > F.col("_lo")))
    # values beyond the bounds count as on them when close, else not at all
    own = own.where((V >= F.col("_lo") - 1e5) & (V <= F.col("_hi") + 1e5)).withColumn("v", F.least(F.greatest("v", "_lo"), "_hi"))
    own = own.withColumn("_bin", F.least(F.floor((V - F.col("_lo")) / step), F.lit(bins - 1)).cast("int"))
    groups = [*same, "_p"]
    exact = own.groupBy(*groups).agg(F.count(V).alias("_n"), percentile(p).alias("_exact"), F.min("t").alias("_t1"), F.max("t").alias("_t2"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    counts = own.groupBy(*groups, "_bin").agg(F.count(V).alias("_c"))
    cumulated = counts.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_bin", "_c"))).alias("_h"))
    rank = F.col("_n") * (float(p) / 100)
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("double").alias("at"))
    found = F.aggregate(
        "_h",
        state,
        lambda s, b: F.struct((s["sum"] + b["_c"]).alias("sum"), F.coalesce(s["at"], F.when(s["sum"] + b["_c"] >= rank, b["_bin"] + 1 - (s["sum"] + b["_c"] - rank) / b["_c"])).alias("at")),
        lambda s: s["at"],
    )
    joined = exact.join(cumulated, groups)
    v = F.when(F.col("_n") <= bins * 4 // 8, F.col("_exact")).otherwise(F.col("_lo") + found * step)
    return d.of(joined.withColumn("v", v.cast("double")).withColumn("ts", F.col("_p")).withColumn("t", middle(F.col("_t1"), F.col("_t2"))))


def timsel_key(n: int, offset: int, skip: int) -> tuple[Column, Column]:
    at = F.col("ts") - offset
    return F.floor(at / (n + skip)), (at >= 0) & (F.pmod(at, F.lit(n + skip)) < n)


def timsel(d: Dataset, value: Column, n: int, offset: int = 0, skip: int = 0) -> Dataset:
    """Groups of n steps after an offset, with skipped steps between; a last, shorter group counts."""
    key, inside = timsel_key(int(n), int(offset), int(skip))
    return over_periods(d.dense().where(inside), key, value)


for _s in TIME_STATS:
    put(f"timsel{_s}", lambda d, n, offset=0, skip=0, s=_s: timsel(d, STATS[s], n, offset, skip))
put("timselpctl", lambda d, p, n, offset=0, skip=0: timsel(d, percentile(p), n, offset, skip))


@op("yearmonmean")
def yearmonmean(d: Dataset) -> Dataset:
    """Yearly mean of monthly steps, weighted by the days of the month."""
    from isohyet.operators.values import days_in_month

    return over_periods(d, F.year("t"), weighted("mean", days_in_month(F.col("t"), d.calendar).cast("double")))


@op("yearmonavg")
def yearmonavg(d: Dataset) -> Dataset:
    from isohyet.operators.values import days_in_month

    return over_periods(d, F.year("t"), weighted("avg", days_in_month(F.col("t"), d.calendar).cast("double")))


@op("tstepcount")
def tstepcount(d: Dataset, ref: float = 0.0) -> Dataset:
    """Number of the first step that has the reference value; missing if none has."""
    return over_time(d.dense(), F.min(F.when(V == float(ref), F.col("ts") + 1)).cast("double"))


# Space

ONE = (0.0,)


def over_field(d: Dataset, value: Column) -> Dataset:
    out = d.cells.groupBy(*FIELD).agg(value.alias("v")).withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    return d.of(out, grid=d.grid.with_(lons=ONE, lats=ONE, mask=None, areas=None))


def over_rows(d: Dataset, value: Column) -> Dataset:
    out = d.cells.groupBy(*FIELD, "y").agg(value.alias("v")).withColumn("x", F.lit(0))
    return d.of(out, grid=d.grid.with_(lons=ONE, mask=None, areas=None))


def over_columns(d: Dataset, value: Column) -> Dataset:
    out = d.cells.groupBy(*FIELD, "x").agg(value.alias("v")).withColumn("y", F.lit(0))
    return d.of(out, grid=d.grid.with_(lats=ONE, mask=None, areas=None))


def boxes(d: Dataset, nx: int, ny: int):  # noqa: ANN201
    """The grid of boxes of nx by ny cells; the last ones may be smaller."""
    cut = lambda c, n: tuple(sum(c[i : i + n]) / len(c[i : i + n]) for i in range(0, len(c), n))
    return d.grid.with_(lons=cut(d.grid.lons, nx), lats=cut(d.grid.lats, ny), mask=None, areas=None)


def over_boxes(d: Dataset, value: Column, nx: int, ny: int) -> Dataset:
    nx, ny = int(nx), int(ny)
    cells = d.cells.withColumn("_bx", F.floor(F.col("x") / nx).cast("int")).withColumn("_by", F.floor(F.col("y") / ny).cast("int"))
    out = cells.groupBy(*FIELD, "_bx", "_by").agg(value.alias("v")).withColumn("x", F.col("_bx")).withColumn("y", F.col("_by"))
    return d.of(out, grid=boxes(d, nx, ny))


for _s in ["min", "max", "sum", "mean", "avg", "var", "var1", "std", "std1"]:
    put(f"fld{_s}", lambda d, s=_s: over_field(d, weighted(s, d.grid.weight())))
for _s in ["min", "max", "range", "sum", "mean", "avg", "var", "std"]:
    put(f"zon{_s}", lambda d, s=_s: over_rows(d, STATS[s]))
for _s in ["min", "max", "sum", "mean", "avg", "var", "std"]:
    put(f"mer{_s}", lambda d, s=_s: over_columns(d, weighted(s, d.grid.weight())))
    put(f"gridbox{_s}", lambda d, nx, ny, s=_s: over_boxes(d, weighted(s, d.grid.weight()), nx, ny))
put("fldpctl", lambda d, p: over_field(d, percentile(p)))
put("zonpctl", lambda d, p: over_rows(d, percentile(p)))
put("merpctl", lambda d, p: over_columns(d, percentile(p)))


# Levels


def thickness(d: Dataset) -> dict[float, float]:
    """Layer thickness of each level: bounds halfway between levels. Levels are few, and known by the axis."""
    levels = sorted(float(r[0]) for r in d.cells.select("level").distinct().collect())
    if len(levels) < 2:
        return {z: 1.0 for z in levels}
    mid = [(a + b) / 2 for a, b in zip(levels, levels[1:])]
    edges = [levels[0], *mid, levels[-1]]
    return {z: abs(b - a) for z, a, b in zip(levels, edges, edges[1:])}


def over_levels(d: Dataset, value: Column) -> Dataset:
    out = d.cells.groupBy("var", "ts", "t", "x", "y").agg(value.alias("v")).withColumn("level", F.lit(0.0))
    return d.of(out).only("level")


def _layer(d: Dataset, relative: bool) -> Column:
    found = thickness(d)
    mean = sum(found.values()) / max(1, len(found)) if relative else 1.0
    out = F
    for z, dz in found.items():
        out = out.when(F.col("level") == z, F.lit(dz / mean))
    return out.otherwise(F.lit(None).cast("double"))


for _s in ["min", "max", "sum"]:
    put(f"vert{_s}", lambda d, s=_s: over_levels(d, STATS[s]))
for _s in ["var", "std"]:
    put(f"vert{_s}", lambda d, s=_s: over_levels(d, STATS[s]))
for _s in ["mean", "avg"]:
    put(f"vert{_s}", lambda d, s=_s: over_levels(d, weighted(s, _layer(d, True))))
put("vertint", lambda d: over_levels(d, F.sum(V * _layer(d, False))))


# Histograms


def _bins(bounds: tuple) -> list[tuple[int, float, float]]:
    edges = [float(b) for b in bounds]
    return [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def histogram(d: Dataset, what: str, *bounds: float) -> Dataset:
    """Per series and half-open bin; bins become levels numbered from 1, and empty bins are 0."""
    bins = _bins(bounds)
    parts = []
    for i, a, b in bins:
        inside = F.when((V >= a) & (V < b), V)
        n, s = F.count(inside), F.coalesce(F.sum(inside), F.lit(0.0))
        value = {"count": n, "sum": s, "mean": F.when(n > 0, s / n).otherwise(0.0), "freq": n / F.nullif(F.count(V), F.lit(0))}[what]
        parts.append(F.struct(F.lit(float(i + 1)).alias("level"), F.when(F.count(V) > 0, value.cast("double")).alias("v")))
    out = d.cells.groupBy("var", "x", "y").agg(F.max("t").alias("t"), *[p.alias(f"_{i}") for i, p in enumerate(parts)])
    out = out.select("var", "x", "y", "t", F.explode(F.array(*[f"_{i}" for i in range(len(parts))])).alias("b"))
    return d.of(out.select("var", "x", "y", "t", F.lit(0).alias("ts"), "b.level", "b.v")).only("ts")


for _s in ["count", "sum", "mean", "freq"]:
    put(f"hist{_s}", lambda d, *bounds, s=_s: histogram(d, s, *bounds))
