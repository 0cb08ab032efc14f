"""Climate indices: counts, run lengths and shares over the whole input, or over its months or years."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.dataset import SERIES, Dataset
from isohyet.functions.kernels import growing_season
from isohyet.operators.pairs import beside
from isohyet.operators.registry import op, put
from isohyet.operators.windows import islands, run_length

V, W = F.col("v"), F.col("w")
KELVIN = 273.15
RUN = 5 + 1  # days of a spell that counts as a period


def _period(t: Column, mode: str) -> Column:
    return {"all": F.lit(0), "year": F.year(t), "month": F.year(t) * 12 + F.month(t) - 1}[mode]


def _over(d: Dataset, value: Column, mode: str = "all", valid: Column | None = None) -> Dataset:
    """An index per series and period; missing where the period has no valid value."""
    there = F.count(F.when(V.isNotNull() if valid is None else valid, 1)) > 0
    out = d.cells.withColumn("_p", _period(F.col("t"), mode)).groupBy(*SERIES, "_p").agg(F.when(there, value).cast("double").alias("v"), F.max("t").alias("t"))
    done = d.of(out.withColumn("ts", F.col("_p")))
    return done.only("ts") if mode == "all" else done


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def counting(name: str, condition: Callable[..., Column]) -> None:
    put(name, lambda d, *args: _over(d, _count(condition(*map(float, args)))))


counting("eca_fd", lambda: V < KELVIN)
counting("eca_id", lambda: V < KELVIN)
counting("eca_su", lambda t=25.0: V > t + KELVIN)
counting("eca_tr", lambda t=20.0: V > t + KELVIN)
counting("eca_rr1", lambda r=1.0: V >= r)
counting("eca_pd", lambda r: V >= r)
counting("eca_r10mm", lambda: V >= 10.0)
counting("eca_r20mm", lambda: V >= 20.0)


def runs(d: Dataset, inside: Column) -> Dataset:
    """cells with _run, the length so far of the spell that a day is in."""
    own = islands(d, inside)
    return own.with_(cells=own.cells.withColumn("_run", run_length()))


def spells(name: str, condition: Callable[..., Column]) -> None:
    """Longest spell; and, as a second result, the number of spells that reach six days."""

    def run(d: Dataset, *args: float) -> tuple[Dataset, Dataset]:
        own = runs(d, condition(*map(float, args)))
        return _over(own, F.max("_run")), _over(own, _count(F.col("_run") == RUN))

    put(name, run)


spells("eca_cfd", lambda: V < KELVIN)
spells("eca_csu", lambda t=25.0: V > t + KELVIN)
spells("eca_cdd", lambda r=1.0: V < r)
spells("eca_cwd", lambda r=1.0: V >= r)


def strong(name: str, least: float) -> None:
    """Days of strong wind; and the longest spell of them."""

    def run(d: Dataset, bound: float = least) -> tuple[Dataset, Dataset]:
        own = runs(d, float(bound) <= V)
        return _over(own, _count(float(bound) <= V)), _over(own, F.max("_run"))

    put(name, run)


for _n, _b in (("strwin", 10.5), ("strbre", 10.5), ("strgal", 20.5), ("hurr", 32.5)):
    strong(_n, _b)


def waves(name: str, condition: Callable[[float], Column], shift: float | None) -> None:
    """Days in spells of at least n days relative to a reference; and the number of such spells.

    A spell's day n counts for n days, each later day for one.
    """

    def run(d: Dataset, ref: Dataset, n: int = RUN, by: float = 5.0) -> tuple[Dataset, Dataset]:
        n = int(n)
        own = d.with_(cells=beside(d, ref))
        own = runs(own, condition(float(by) if shift is not None else 0.0))
        days = F.sum(F.when(F.col("_run") == n, n).when(F.col("_run") > n, 1).otherwise(0))
        valid = V.isNotNull() & W.isNotNull()
        return _over(own, days, valid=valid), _over(own, _count(F.col("_run") == n), valid=valid)

    put(name, run, 2)


waves("eca_cwdi", lambda by: W - by > V, 5.0)
waves("eca_hwdi", lambda by: W + by < V, 5.0)
waves("eca_cwfi", lambda by: W > V, None)
waves("eca_hwfi", lambda by: W < V, None)


def shares(name: str, condition: Column) -> None:
    """Percent of the valid days."""

    def run(d: Dataset, ref: Dataset) -> Dataset:
        own = d.with_(cells=beside(d, ref))
        return _over(own, 100 * _count(condition) / F.nullif(F.count(V), F.lit(0)), valid=V.isNotNull() & W.isNotNull())

    put(name, run, 2)


for _v in ("tg", "tn", "tx"):
    shares(f"eca_{_v}10p", W > V)
    shares(f"eca_{_v}90p", W < V)


def wet(p: int) -> None:
    """Share of the wet days above the reference, and of the precipitation that they bring."""

    def days(d: Dataset, ref: Dataset) -> Dataset:
        own = d.with_(cells=beside(d, ref))
        return _over(own, 100 * _count((V >= 1) & (W < V)) / F.nullif(_count(V >= 1), F.lit(0)))

    def total(d: Dataset, ref: Dataset) -> Dataset:
        own = d.with_(cells=beside(d, ref))
        return _over(own, 100 * F.coalesce(F.sum(F.when((V >= 1) & (W < V), V)), F.lit(0.0)) / F.nullif(F.sum(V), F.lit(0.0)))

    put(f"eca_r{p}p", days, 2)
    put(f"eca_r{p}ptot", total, 2)


for _p in (75, 90, 95, 99):
    wet(_p)


@op("eca_etr")
def eca_etr(high: Dataset, low: Dataset) -> Dataset:
    """Highest maximum less lowest minimum."""
    own = high.with_(cells=beside(high, low))
    return _over(own, F.max(V) - F.min(W), valid=V.isNotNull() & W.isNotNull())


@op("eca_hd")
def eca_hd(d: Dataset, t1: float = 17.0, t2: float | None = None) -> Dataset:
    """Heating degree days: what is missing to t1 on days colder than t2, in degrees Celsius."""
    t1 = float(t1)
    t2 = t1 if t2 is None else float(t2)
    return _over(d, F.coalesce(F.sum(F.when(V < t2 + KELVIN, t1 + KELVIN - V)), F.lit(0.0)))


@op("eca_rx1day")
def eca_rx1day(d: Dataset, mode: str = "") -> Dataset:
    return _over(d, F.max(V), "month" if mode == "m" else "all")


@op("eca_rx5day")
def eca_rx5day(d: Dataset, bound: float = 50.0) -> tuple[Dataset, Dataset]:
    """Highest five-day sum (the input's values are such sums); and how many reach the bound."""
    return _over(d, F.max(V)), _over(d, _count(float(bound) <= V))


@op("eca_sdii")
def eca_sdii(d: Dataset, r: float = 1.0) -> Dataset:
    return _over(d, F.avg(F.when(float(r) <= V, V)))


@op("fdns")
def fdns(temperature: Dataset, snow: Dataset) -> Dataset:
    """Frost days without snow."""
    own = temperature.with_(cells=beside(temperature, snow))
    return _over(own, _count((V <= KELVIN) & (W <= 0.01)), valid=V.isNotNull() & W.isNotNull())


@op("eca_gsl")
def eca_gsl(d: Dataset, land: Dataset, n: int = 6, t: float = 5.0, fraction: float = 0.5) -> tuple[Dataset, Dataset]:
    """Growing season of each year: its length, and the day of the year on which it begins.

    It begins with the first n days in a row above t in the first half of the year (the
    second half, south of the equator, into the next year), and ends before the first n days in
    a row below t thereafter in the other half. Cells with less land than fraction are missing.
    """
    n, t = int(n), float(t) + KELVIN
    south = d.lat() < 0
    lnd = land.cells.where(F.col("v") >= float(fraction)).select("x", "y").distinct()
    day = F.when(south, F.add_months("t", -6)).otherwise(F.to_date("t"))
    cells = d.cells.join(lnd, ["x", "y"]).withColumns({"_year": F.year(day), "_late": F.month(day) > 6})

    found = F.pandas_udf(lambda v, late: pd.DataFrame([growing_season(a, b, n, t) for a, b in zip(v, late)], columns=["length", "start"]), "length double, start int")
    years = cells.groupBy(*SERIES, "_year").agg(F.max("t").alias("t"), F.array_sort(F.collect_list(F.struct("t", "v", "_late"))).alias("_s"))
    out = years.withColumn("_f", found("_s.v", "_s._late")).withColumns({"length": F.col("_f.length"), "start": F.dayofyear(F.get("_s.t", F.col("_f.start")))})
    named = out.withColumn("ts", F.col("_year"))
    return d.of(named.withColumn("v", F.col("length"))), d.of(named.withColumn("v", F.col("start").cast("double")))
