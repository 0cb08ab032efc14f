"""Operators on single values: functions, constants, comparisons, missing values, replacements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.dataset import Dataset
from isohyet.operators.registry import op, put

V = F.col("v")


def mul0(a: Column, b: Column) -> Column:
    """A product that is 0 where a factor is 0, even if the other is missing."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(a * b)


def div0(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def nint(v: Column) -> Column:
    return F.when(v < 0, F.ceil(v - 0.5)).otherwise(F.floor(v + 0.5)).cast("double")


def _log(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(v > 0, f(v)).when(v == 0, F.lit(float("-inf")))


FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "int": lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"),
    "nint": nint,
    "sqr": lambda v: v * v,
    "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)),
    "exp": F.exp,
    "ln": lambda v: _log(v, F.log),
    "log10": lambda v: _log(v, F.log10),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": lambda v: F.when(F.abs(v) <= 1, F.asin(v)),
    "acos": lambda v: F.when(F.abs(v) <= 1, F.acos(v)),
    "atan": F.atan,
    "reci": lambda v: 1 / F.nullif(v, F.lit(0.0)),
}
WITH_CONSTANT: dict[str, Callable[[Column, float], Column]] = {
    "addc": lambda v, c: v + c,
    "subc": lambda v, c: v - c,
    "mulc": lambda v, c: mul0(v, F.lit(c)),
    "divc": lambda v, c: div0(v, F.lit(c)),
    "mod": lambda v, c: v % F.nullif(F.lit(c), F.lit(0.0)),
    "pow": lambda v, c: F.pow(v, F.lit(c)),
    "eqc": lambda v, c: (v == c).cast("double"),
    "nec": lambda v, c: (v != c).cast("double"),
    "lec": lambda v, c: (v <= c).cast("double"),
    "ltc": lambda v, c: (v < c).cast("double"),
    "gec": lambda v, c: (v >= c).cast("double"),
    "gtc": lambda v, c: (v > c).cast("double"),
    "ifthenc": lambda v, c: F.when(v != 0, F.lit(c)),
    "ifnotthenc": lambda v, c: F.when(v == 0, F.lit(c)),
    "setmisstoc": lambda v, c: F.coalesce(v, F.lit(c)),
}

for _name, _f in FUNCTIONS.items():
    put(_name, lambda d, f=_f: d.map(f(V)))
for _name, _f in WITH_CONSTANT.items():
    put(_name, lambda d, c, f=_f: d.map(f(V, float(c))))


def _single(c: float) -> Column:
    """The constant as it is after storage in 32 bits."""
    return F.lit(float(c)).cast("float").cast("double")


@op("setctomiss")
def setctomiss(d: Dataset, c: float) -> Dataset:
    """The constant, also as rounded to single precision, becomes missing."""
    return d.map(F.when((V != float(c)) & (V != _single(c)), V))


@op("setmissval")
def setmissval(d: Dataset, c: float) -> Dataset:
    """Missing values are null here; values that equal the new marker become missing."""
    return d.map(F.when(V != float(c), V)).with_(attrs=d.attrs | {"missing_value": str(c)})


@op("setrtomiss")
def setrtomiss(d: Dataset, low: float, high: float) -> Dataset:
    return d.map(F.when(~V.between(float(low), float(high)), V))


@op("setvrange")
def setvrange(d: Dataset, low: float, high: float) -> Dataset:
    return d.map(F.when(V.between(float(low), float(high)), V))


@op("setvals")
def setvals(d: Dataset, *pairs: float) -> Dataset:
    """old1, new1, old2, new2 ...; the first that matches counts."""
    out = None
    for old, new in zip(pairs[::2], pairs[1::2]):
        out = (F if out is None else out).when(V == float(old), F.lit(float(new)))
    return d.map(out.otherwise(V))


@op("setrtoc")
def setrtoc(d: Dataset, low: float, high: float, c: float) -> Dataset:
    return d.map(F.when(V.between(float(low), float(high)), F.lit(float(c))).otherwise(V))


@op("setrtoc2")
def setrtoc2(d: Dataset, low: float, high: float, c: float, other: float) -> Dataset:
    return d.map(F.when(V.between(float(low), float(high)), F.lit(float(c))).when(V.isNotNull(), F.lit(float(other))))


def days_in_month(t: Column, calendar: str = "standard") -> Column:
    if calendar == "360_day":
        return F.lit(30)
    feb = F.month(t) == 2
    if calendar in ("365_day", "366_day"):
        return F.when(feb, int(calendar == "366_day") + 28).otherwise(F.day(F.last_day(t)))
    return F.day(F.last_day(t))


def days_in_year(t: Column, calendar: str = "standard") -> Column:
    if calendar in ("360_day", "365_day", "366_day"):
        return F.lit(int(calendar[:3]))
    return F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31)))


put("muldpm", lambda d: d.map(mul0(V, days_in_month(F.col("t"), d.calendar).cast("double"))))
put("divdpm", lambda d: d.map(V / days_in_month(F.col("t"), d.calendar)))
put("muldpy", lambda d: d.map(mul0(V, days_in_year(F.col("t"), d.calendar).cast("double"))))
put("divdpy", lambda d: d.map(V / days_in_year(F.col("t"), d.calendar)))
put("muldoy", lambda d: d.map(mul0(V, F.dayofyear("t").cast("double"))))
put("mulcoslat", lambda d: d.map(V * F.cos(F.radians(d.lat()))))
put("divcoslat", lambda d: d.map(div0(V, F.cos(F.radians(d.lat())))))


def in_lonlat(d: Dataset, lon1: float, lon2: float, lat1: float, lat2: float) -> Column:
    """Inside the box; longitudes count modulo 360."""
    lon1, lon2, lat1, lat2 = map(float, (lon1, lon2, lat1, lat2))
    lon = d.lon()
    around = F.lit(False)
    for turn in (-360, 0, 360):
        around |= (lon + turn).between(min(lon1, lon2) if lon2 >= lon1 else lon1, lon2 if lon2 >= lon1 else lon2 + 360)
    return around & d.lat().between(min(lat1, lat2), max(lat1, lat2))


def in_index(d: Dataset, x1: int, x2: int, y1: int, y2: int) -> Column:
    """Inside the index box, counted from 1; a left bound beyond the right one goes around."""
    x1, x2, y1, y2 = (int(i) - 1 for i in (x1, x2, y1, y2))
    y1, y2 = max(0, min(y1, y2)), min(d.grid.ny - 1, max(y1, y2))
    x = F.col("x")
    across = x.between(x1, x2) if x1 <= x2 else (x >= x1) | (x <= x2)
    return across & F.col("y").between(y1, y2)


put("masklonlatbox", lambda d, *box: d.map(F.when(in_lonlat(d, *box), V)))
put("maskindexbox", lambda d, *box: d.map(F.when(in_index(d, *box), V)))
put("setclonlatbox", lambda d, c, *box: d.map(F.when(in_lonlat(d, *box), F.lit(float(c))).otherwise(V)))
put("setcindexbox", lambda d, c, *box: d.map(F.when(in_index(d, *box), F.lit(float(c))).otherwise(V)))


@op("maskregion")
def maskregion(d: Dataset, *regions: object) -> Dataset:
    """Values outside all polygons (lists of lon, lat) become missing.

    Whether a centre is inside is a sum over the edges of crossings of its parallel.
    """
    inside = F.lit(False)
    lon, lat = d.lon(), d.lat()
    for polygon in regions:
        points = [tuple(map(float, p)) for p in (_polygon(polygon) if isinstance(polygon, str) else polygon)]
        crossings = F.lit(0)
        for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
            if y1 != y2:
                at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
                crossings = crossings + F.when(((lat >= min(y1, y2)) & (lat < max(y1, y2)) & (at > lon)), 1).otherwise(0)
        inside |= crossings % 2 == 1
    return d.map(F.when(inside, V))


def _polygon(path: str) -> list[list[str]]:
    with open(path) as f:
        return [line.split()[:2] for line in f if line.strip() and line[0] not in "#&"]


put("retocomplex", lambda d: d.map(V).with_(attrs=d.attrs | {"complex": "re"}))
