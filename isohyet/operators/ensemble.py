"""Statistics across datasets of one shape, and verification of ensembles against an observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.dataset import COLUMNS, Dataset
from isohyet.operators.registry import op, put
from isohyet.operators.stats import ONE, STATS, TIME_STATS, percentile

V = F.col("v")
KT = ["var", "level", "ts", "x", "y"]


def members(datasets: list[Dataset]) -> DataFrame:
    out = None
    for k, d in enumerate(datasets):
        own = d.cells.select(*COLUMNS).withColumn("member", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def over_members(datasets: list[Dataset], value: Column) -> Dataset:
    out = members(datasets).groupBy(*KT).agg(value.cast("double").alias("v"), F.max("t").alias("t"))
    return datasets[0].of(out)


for _s in TIME_STATS:
    put(f"ens{_s}", lambda ds, s=_s: over_members(ds, STATS[s]), -1)
put("enspctl", lambda ds, p: over_members(ds, percentile(p)), -1)


def _observed(datasets: list[Dataset]) -> DataFrame:
    """(keys, t, obs, members array): the first dataset is the observation; points with a missing value go."""
    own = members(datasets).groupBy(*KT).agg(F.max("t").alias("t"), F.max(F.when(F.col("member") == 0, V)).alias("obs"), F.array_sort(F.collect_list(F.when(F.col("member") > 0, V))).alias("members"))
    return own.where(F.col("obs").isNotNull() & (F.size("members") == len(datasets) - 1))


def _rank() -> Column:
    """How many members lie below the observation."""
    return F.size(F.filter("members", lambda m: m < F.col("obs"))).cast("double")


@op("ensrkhist_space", inputs=-1)
def ensrkhist_space(datasets: list[Dataset]) -> Dataset:
    """Per grid point, counts of the observation's rank over time; ranks become levels."""
    out = _observed(datasets).withColumn("level", _rank()).groupBy("var", "level", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("v"), F.max("t").alias("t"))
    return datasets[0].of(out.withColumn("ts", F.lit(0))).only("ts")


@op("ensrkhist_time", inputs=-1)
def ensrkhist_time(datasets: list[Dataset]) -> Dataset:
    """Per step, counts of the observation's rank over space; ranks become levels."""
    out = _observed(datasets).withColumn("level", _rank()).groupBy("var", "level", "ts", "t").agg(F.count(F.lit(1)).cast("double").alias("v"))
    d = datasets[0]
    return d.of(out.withColumns({"x": F.lit(0), "y": F.lit(0)}), grid=d.grid.with_(lons=ONE, lats=ONE))


@op("ensroc", inputs=-1)
def ensroc(datasets: list[Dataset], bins: int = 10) -> Dataset:
    """Area under the curve of hit rate over false alarm rate, for events where the value exceeds 0.5."""
    n = int(bins)
    share = F.size(F.filter("members", lambda m: m > 0.5)) / F.size("members")
    own = _observed(datasets).select("var", "level", "ts", "t", share.alias("p"), (F.col("obs") > 0.5).alias("event"))
    hits = [F.count(F.when(F.col("event") & (F.col("p") >= k / n), 1)) / F.nullif(F.count(F.when(F.col("event"), 1)), F.lit(0)) for k in range(n + 1)]
    alarms = [F.count(F.when(~F.col("event") & (F.col("p") >= k / n), 1)) / F.nullif(F.count(F.when(~F.col("event"), 1)), F.lit(0)) for k in range(n + 1)]
    hits, alarms = [*hits, F.lit(0.0)], [*alarms, F.lit(0.0)]
    area = sum(((alarms[k] - alarms[k + 1]) * (hits[k] + hits[k + 1]) / 2 for k in range(n + 1)), F.lit(0.0))
    out = own.groupBy("var", "level").agg(area.alias("v"), F.max("t").alias("t"))
    d = datasets[0]
    return d.of(out.withColumns({"x": F.lit(0), "y": F.lit(0), "ts": F.lit(0)}), grid=d.grid.with_(lons=ONE, lats=ONE)).only("ts")


@op("enscrps", inputs=-1)
def enscrps(datasets: list[Dataset]) -> tuple[Dataset, Dataset, Dataset]:
    """Continuous ranked probability score and its reliability and potential parts, per field.

    alpha and beta are the area-weighted lengths of the intervals between sorted members
    to the left and to the right of the observation.
    """
    d, n = datasets[0], len(datasets) - 1
    own = _observed(datasets).withColumn("w", d.grid.weight())
    low = lambda k: F.get("members", F.lit(k))
    obs = F.col("obs")
    parts = []
    for k in range(n + 1):
        if k == 0:
            alpha, beta = F.lit(0.0), F.greatest(low(0) - obs, F.lit(0.0))
        elif k == n:
            alpha, beta = F.greatest(obs - low(n - 1), F.lit(0.0)), F.lit(0.0)
        else:
            inside = F.least(F.greatest(obs, low(k - 1)), low(k))
            alpha, beta = inside - low(k - 1), low(k) - inside
        parts += [F.sum(F.col("w") * alpha).alias(f"a{k}"), F.sum(F.col("w") * beta).alias(f"b{k}")]
    sums = own.groupBy("var", "level", "ts", "t").agg(F.sum("w").alias("w"), F.sum(F.col("w") * (low(0) > obs).cast("int")).alias("under"), F.sum(F.col("w") * (low(n - 1) < obs).cast("int")).alias("over"), *parts)
    reli = pot = crps = F.lit(0.0)
    for k in range(n + 1):
        a, b = F.col(f"a{k}") / F.col("w"), F.col(f"b{k}") / F.col("w")
        p = k / n
        if k == 0:  # outliers: the share of observations outside takes the place of the interval
            o = F.col("under") / F.col("w")
            g = F.when(o > 0, b / o).otherwise(0.0)
        elif k == n:
            o = 1 - F.col("over") / F.col("w")
            g = F.when(o < 1, a / (1 - o)).otherwise(0.0)
        else:
            g = a + b
            o = F.when(g > 0, b / g).otherwise(0.0)
        reli, pot, crps = reli + g * (o - p) * (o - p), pot + g * o * (1 - o), crps + g * ((1 - o) * p * p + o * (1 - p) * (1 - p))
    place = {"x": F.lit(0), "y": F.lit(0)}
    out = sums.select("var", "level", "ts", "t", crps.alias("crps"), reli.alias("reli"), pot.alias("pot")).withColumns(place)
    grid = d.grid.with_(lons=ONE, lats=ONE)
    return tuple(d.of(out.withColumn("v", F.col(c)), grid=grid) for c in ("crps", "reli", "pot"))


@op("ensbrs", inputs=-1)
def ensbrs(datasets: list[Dataset], threshold: float) -> tuple[Dataset, ...]:
    """Brier score for exceeding a threshold, with reliability, resolution and uncertainty."""
    d, x, n = datasets[0], float(threshold), len(datasets) - 1
    own = _observed(datasets).withColumn("w", d.grid.weight())
    own = own.withColumn("k", F.size(F.filter("members", lambda m: m > x))).withColumn("o", (F.col("obs") > x).cast("double"))
    groups = own.groupBy("var", "level", "ts", "t", "k").agg(F.sum("w").alias("g"), F.sum(F.col("w") * F.col("o")).alias("go"))
    f = groups.groupBy("var", "level", "ts", "t")
    p, o = F.col("k") / n, F.col("go") / F.col("g")
    total = F.sum("g")
    base = F.sum("go") / total
    reli = F.sum(F.col("g") * (p - o) * (p - o)) / total
    second = F.sum(F.col("g") * o * o) / total
    reso = second - base * base
    unct = base * (1 - base)
    place = {"x": F.lit(0), "y": F.lit(0)}
    out = f.agg((reli - reso + unct).alias("brs"), reli.alias("reli"), reso.alias("reso"), unct.alias("unct")).withColumns(place)
    grid = d.grid.with_(lons=ONE, lats=ONE)
    return tuple(d.of(out.withColumn("v", F.col(c)), grid=grid) for c in ("brs", "reli", "reso", "unct"))
