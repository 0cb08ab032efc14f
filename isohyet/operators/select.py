"""Selection of variables, levels, steps and boxes: filters that reach the scan."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohyet.dataset import Dataset
from isohyet.operators.registry import op, put
from isohyet.operators.values import in_index, in_lonlat

LEVEL_TOLERANCE = 1e-4
MONTHS = "JFMAMJJASONDJFMAMJJASOND"
#: Attributes of variables that operators select by.
META = {"param": "param", "code": "code", "stdname": "stdname", "grid": "grid", "zaxis": "zaxis", "tabnum": "tabnum", "ltype": "ltype"}


def numbers(args: tuple) -> list[int]:
    """1, 3/7 and 1/9/2 (first/last/increment)."""
    out: list[int] = []
    for a in args:
        if isinstance(a, str) and "/" in a:
            first, last, *step = (int(p) for p in a.split("/"))
            by = step[0] if step else (1 if last >= first else -1)
            out += range(first, last + (1 if by > 0 else -1), by)
        else:
            out.append(int(float(a)))
    return out


def months_of(season: str | int) -> list[int]:
    """Months of a run of initials as in DJF, or of a season's number 13 (winter) to 16 (autumn)."""
    text = str(season).upper()
    if text == "ANN":
        return list(range(1, 13))
    if text.isdigit():
        n = int(text)
        return months_of(("DJF", "MAM", "JJA", "SON")[n - 13]) if n > 12 else [n]
    at = MONTHS.find(text)
    if at < 0 or not text:
        raise ValueError(f"no season is named {season}")
    return [(at + k) % 12 + 1 for k in range(len(text))]


def near_levels(levels: tuple) -> Column:
    found = F.lit(False)
    for z in levels:
        found |= F.abs(F.col("level") - float(z)) < LEVEL_TOLERANCE
    return found


def by_meta(d: Dataset, key: str, wanted: tuple) -> Column:
    names = [n for n, m in d.variables.items() if str(m.get(key, "")) in {str(w) for w in wanted}]
    return F.col("var").isin(names)


def _pattern(text: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, c if c in "[]" else re.escape(c)) for c in text) + "$"


def named(d: Dataset, patterns: tuple) -> Column:
    """Names, in which * and ? stand for any."""
    found = F.lit(False)
    for p in patterns:
        found |= F.col("var").rlike(_pattern(str(p))) if any(c in str(p) for c in "*?[") else F.col("var") == str(p)
    return found


def _select_names(d: Dataset, *names: str) -> Dataset:
    out = d.where(named(d, names))
    plain = len(names) == 1 and not any(c in str(names[0]) for c in "*?[")
    kept = {n: m for n, m in d.variables.items() if any(fnmatch.fnmatchcase(n, str(p)) for p in names)}
    return out.with_(variables=kept).only(*(["var"] if plain else []))


put("selname", _select_names)
put("delname", lambda d, *names: d.where(~named(d, names)).with_(variables={n: m for n, m in d.variables.items() if not any(fnmatch.fnmatchcase(n, str(p)) for p in names)}))
for _k, _key in META.items():
    put(f"sel{_k}", lambda d, *w, k=_key: d.where(by_meta(d, k, w)))
for _k in ("param", "code"):
    put(f"del{_k}", lambda d, *w, k=_k: d.where(~by_meta(d, k, w)))
put("sellevel", lambda d, *z: d.where(near_levels(z)).only(*(["level"] if len(z) == 1 else [])))
put("seloperator", lambda d, code, ltype, level: d.where(by_meta(d, "code", (code,)) & by_meta(d, "ltype", (ltype,)) & near_levels((level,))))


@op("sellevidx")
def sellevidx(d: Dataset, *idx: str) -> Dataset:
    """Levels by their position, from 1, in ascending order within each variable."""
    axis = d.cells.select("var", "level").distinct().withColumn("_i", F.row_number().over(W.partitionBy("var").orderBy("level")))
    return d.of(d.cells.join(axis.where(F.col("_i").isin(numbers(idx))), ["var", "level"]))


@op("selrec")
def selrec(d: Dataset, *idx: str) -> Dataset:
    """Records (variable and level of a step) by their position, from 1, in order of step, variable and level."""
    records = d.cells.select("ts", "var", "level").distinct().withColumn("_i", F.row_number().over(W.orderBy("ts", "var", "level")))
    return d.of(d.cells.join(records.where(F.col("_i").isin(numbers(idx))), ["ts", "var", "level"]))


@op("seltimestep")
def seltimestep(d: Dataset, *idx: str) -> Dataset:
    """Steps by their number from 1; negative ones count from the end."""
    wanted = numbers(idx)
    axis = d.steps().select("ts", F.row_number().over(W.orderBy("ts")).alias("_i"), F.row_number().over(W.orderBy(F.desc("ts"))).alias("_j"))
    chosen = axis.where(F.col("_i").isin(wanted) | (-F.col("_j")).isin(wanted))
    return d.of(d.cells.join(chosen, "ts")).only(*(["ts"] if len(wanted) == 1 else []))


T = F.col("t")
put("selyear", lambda d, *w: d.where(F.year(T).isin(numbers(w))))
put("selmon", lambda d, *w: d.where(F.month(T).isin(numbers(w))))
put("selday", lambda d, *w: d.where(F.day(T).isin(numbers(w))))
put("selhour", lambda d, *w: d.where(F.hour(T).isin(numbers(w))))
put("seltime", lambda d, *w: d.where(F.date_format(T, "HH:mm:ss").isin([str(x) for x in w])))
put("selseas", lambda d, *w: d.where(F.month(T).isin(sorted({m for s in w for m in months_of(s)}))))
put("delday", lambda d, day="29feb": d.where(~_is_day(day)))
put("del29feb", lambda d: d.where(~((F.month(T) == 2) & (F.day(T) == 29))))


def _is_day(text: str) -> Column:
    """A day of the month, with or without a month's name behind it."""
    digits = "".join(c for c in text if c.isdigit())
    name = text[len(digits) :].lower()
    found = F.day(T) == int(digits)
    return found & (F.month(T) == ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"].index(name[:3]) + 1) if name else found


@op("seldate")
def seldate(d: Dataset, first: str, last: str | None = None) -> Dataset:
    """From a date to another, both included; a date without a time means the whole day."""
    last = last or first
    end = F.lit(last).cast("timestamp")
    upper = T <= end if "T" in last or ":" in last else F.lit(False) | (T < end + F.expr("INTERVAL 1 DAY"))
    return d.where((F.lit(first).cast("timestamp") <= T) & upper)


@op("selsmon")
def selsmon(d: Dataset, month: int, before: int = 0, after: int | None = None) -> Dataset:
    """A month and a number of steps before and behind it."""
    before, after = int(before), int(before if after is None else after)
    flag = F.max((F.month("t") == int(month)).cast("int")).over(W.orderBy("ts").rowsBetween(-after, before))
    return d.of(d.cells.join(d.steps().select("ts", flag.alias("_f")).where("_f = 1"), "ts"))


@op("sellonlatbox")
def sellonlatbox(d: Dataset, lon1: float, lon2: float, lat1: float, lat2: float) -> Dataset:
    lon1, lon2, lat1, lat2 = map(float, (lon1, lon2, lat1, lat2))
    upper = lon2 if lon2 >= lon1 else lon2 + 360

    def turned(lon: float) -> float | None:
        return next((lon + k for k in (0, -360, 360) if lon1 <= lon + k <= upper), None)

    xs = sorted((t, i) for i, lon in enumerate(d.grid.lons) if (t := turned(lon)) is not None)
    ys = [j for j, lat in enumerate(d.grid.lats) if min(lat1, lat2) <= lat <= max(lat1, lat2)]
    grid = d.grid.with_(lons=tuple(t for t, _ in xs), lats=tuple(d.grid.lats[j] for j in ys), mask=None, areas=None)
    return _reindexed(d.where(in_lonlat(d, lon1, lon2, lat1, lat2)), [i for _, i in xs], ys, grid)


@op("selindexbox")
def selindexbox(d: Dataset, x1: int, x2: int, y1: int, y2: int) -> Dataset:
    a, b, c, e = (int(i) - 1 for i in (x1, x2, y1, y2))
    xs = list(range(a, b + 1)) if a <= b else [*range(a, d.grid.nx), *range(b + 1)]
    ys = list(range(max(0, min(c, e)), min(d.grid.ny - 1, max(c, e)) + 1))
    lons = tuple(d.grid.lons[i] + (0 if a <= b or i <= b else -360) for i in xs)
    grid = d.grid.with_(lons=lons, lats=tuple(d.grid.lats[j] for j in ys), mask=None, areas=None)
    return _reindexed(d.where(in_index(d, x1, x2, y1, y2)), xs, ys, grid)


def _reindexed(d: Dataset, xs: list[int], ys: list[int], grid: object) -> Dataset:
    at = lambda c, own: F.array_position(F.lit(own), F.col(c).cast("int")).cast("int") - 1 if own != list(range(own[0], own[0] + len(own))) else F.col(c) - own[0]
    cells = d.cells.withColumns({"x": at("x", xs), "y": at("y", ys)}) if xs and ys else d.cells
    return d.of(cells, grid=grid)


#: Keywords of select and delete, and what they compare.
def _keywords(d: Dataset, options: dict[str, list[str]]) -> Column:
    found = F.lit(True)
    for key, wanted in options.items():
        w = tuple(wanted)
        found &= {
            "name": lambda: named(d, w),
            "level": lambda: near_levels(w),
            "year": lambda: F.year(T).isin(numbers(w)),
            "month": lambda: F.month(T).isin(numbers(w)),
            "day": lambda: F.day(T).isin(numbers(w)),
            "hour": lambda: F.hour(T).isin(numbers(w)),
            "minute": lambda: F.minute(T).isin(numbers(w)),
            "season": lambda: F.month(T).isin(sorted({m for s in w for m in months_of(s)})),
            "timestep": lambda: F.col("ts").isin([n - 1 for n in numbers(w)]),
            "date": lambda: F.date_format(T, "yyyy-MM-dd'T'HH:mm:ss").startswith(w[0]),
        }.get(key, lambda key=key: by_meta(d, key, w))()
    return found


def keywords(args: tuple) -> dict[str, list[str]]:
    """key=value,value,... as it is split at commas."""
    out: dict[str, list[str]] = {}
    key = ""
    for a in args:
        text = str(a)
        if "=" in text:
            key, text = text.split("=", 1)
        out.setdefault(key, []).append(text)
    return out


@op("select", inputs=-1)
def select(datasets: list[Dataset], *args: str) -> Dataset:
    from isohyet.dataset import union

    d = datasets[0].with_(cells=union(datasets))
    return d.where(_keywords(d, keywords(args)))


@op("delete", inputs=-1)
def delete(datasets: list[Dataset], *args: str) -> Dataset:
    from isohyet.dataset import union

    d = datasets[0].with_(cells=union(datasets))
    return d.where(~_keywords(d, keywords(args)))
