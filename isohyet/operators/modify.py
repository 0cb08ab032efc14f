"""Changes of metadata, coordinates and layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.dataset import Dataset, union
from isohyet.grid import Grid, named
from isohyet.operators.registry import op, put

META = ["code", "param", "stdname", "longname", "unit", "tabnum", "ltype"]


def _meta(d: Dataset, key: str, change: Callable[[str, dict], object]) -> Dataset:
    return d.with_(variables={n: m | {key: change(n, m)} for n, m in d.variables.items()})


for _k in META:
    put(f"set{_k}", lambda d, x, k=_k: _meta(d, k, lambda n, m: x))


def pairs(args: tuple) -> dict[str, str]:
    return dict(zip(map(str, args[::2]), args[1::2]))


for _k in ("code", "param", "unit", "tabnum", "ltype"):
    put(f"ch{_k}", lambda d, *args, k=_k: _meta(d, k, lambda n, m: pairs(args).get(str(m.get(k, "")), m.get(k))))


def _renamed(d: Dataset, new: dict[str, str]) -> Dataset:
    out = F.col("var")
    for old, name in new.items():
        out = F.when(F.col("var") == old, F.lit(name)).otherwise(out)
    cells = d.cells.withColumn("var", out) if new else d.cells
    return d.of(cells, variables={new.get(n, n): m for n, m in d.variables.items()})


put("chname", lambda d, *args: _renamed(d, pairs(args)))


@op("setname")
def setname(d: Dataset, *names: str) -> Dataset:
    """New names, one for each variable in order; one name alone is that of the only variable."""
    if len(names) == 1 and len(d.variables) < 2:
        return d.of(d.cells.withColumn("var", F.lit(names[0])), variables={names[0]: next(iter(d.variables.values()), {})})
    return _renamed(d, dict(zip(d.variables, names)))


@op("setlevel")
def setlevel(d: Dataset, level: float) -> Dataset:
    return d.of(d.cells.withColumn("level", F.lit(float(level)))).only("level")


def _levels(args: tuple) -> Column:
    out = F.col("level")
    for old, new in pairs(args).items():
        out = F.when(F.abs(F.col("level") - float(old)) < 1e-4, F.lit(float(new))).otherwise(out)
    return out


put("chlevel", lambda d, *args: d.of(d.cells.withColumn("level", _levels(args))))
put("chlevelv", lambda d, name, *args: d.of(d.cells.withColumn("level", F.when(F.col("var") == name, _levels(args)).otherwise(F.col("level")))))
put("chlevelc", lambda d, code, *args: d.of(d.cells.withColumn("level", F.when(F.col("var").isin([n for n, m in d.variables.items() if str(m.get("code")) == str(code)]), _levels(args)).otherwise(F.col("level")))))


def _partab(d: Dataset, table: dict | str, key: str, convert: str = "") -> Dataset:
    """Metadata from a table of entries by code, param or name; with convert, values by its factor."""
    from isohyet.sources.tables import read_table

    rows = read_table(table) if isinstance(table, str) else table
    found = {n: next((r for r in rows if str(r.get(key)) == str(n if key == "name" else m.get(key))), None) for n, m in d.variables.items()}
    out = d.with_(variables={n: m | {k: v for k, v in (found[n] or {}).items() if k not in ("name", "out_name", "factor")} for n, m in d.variables.items()})
    if convert:
        factor = F.lit(1.0)
        for n, r in found.items():
            if r and "factor" in r:
                factor = F.when(F.col("var") == n, F.lit(float(r["factor"]))).otherwise(factor)
        out = out.map(F.col("v") * factor)
    return _renamed(out, {n: str(r["out_name"]) for n, r in found.items() if r and "out_name" in r})


put("setpartabc", lambda d, table, convert="": _partab(d, table, "code", convert))
put("setpartabp", lambda d, table, convert="": _partab(d, table, "param", convert))
put("setpartabn", lambda d, table, convert="": _partab(d, table, "name", convert))
put("setpartab", lambda d, table: _partab(d, table, "code"))
put("setrcaname", lambda d, table: _partab(d, table, "code"))

# Time

T = F.col("t")


def _timed(d: Dataset, t: Column) -> Dataset:
    return d.of(d.cells.withColumn("t", t.cast("timestamp")))


def _made(year: object = None, month: object = None, day: object = None) -> Column:
    first = F.make_date(F.year(T) if year is None else F.lit(int(year)), F.month(T) if month is None else F.lit(int(month)), F.lit(1))
    date = F.least(F.date_add(first, (F.day(T) if day is None else F.lit(int(day))) - 1), F.last_day(first))
    return F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + F.unix_micros(T) - F.unix_micros(F.date_trunc("day", T)))


put("setyear", lambda d, y: _timed(d, _made(year=y)))
put("setmon", lambda d, m: _timed(d, _made(month=m)))
put("setday", lambda d, x: _timed(d, _made(day=x)))
put("setdate", lambda d, date: _timed(d, F.timestamp_micros(F.unix_micros(F.lit(date).cast("timestamp")) + F.unix_micros(T) - F.unix_micros(F.date_trunc("day", T)))))
put("settime", lambda d, time: _timed(d, F.concat(F.date_format(T, "yyyy-MM-dd"), F.lit(" " + time))))
put("settunits", lambda d, units: d.with_(attrs=d.attrs | {"time_units": units}))
put("setreftime", lambda d, date, time="00:00:00", units="": d.with_(attrs=d.attrs | {"reference_time": f"{date} {time}", "time_units": units or d.attrs.get("time_units", "")}))
put("setcalendar", lambda d, calendar: d.with_(calendar=calendar))


def increment(text: str) -> tuple[int, str]:
    """6hours, 1mon, -1year: a number and months, or seconds."""
    digits = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    n, unit = int(digits or 1), text[len(digits) :].rstrip("s") or "hour"
    scale = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400}
    if unit in scale:
        return n * scale[unit], "second"
    return n * {"month": 1, "mon": 1, "year": 12}[unit], "month"


def shifted(t: Column, n: Column | int, unit: str) -> Column:
    """Months keep the day where it exists, else end with the month."""
    n = F.lit(n) if isinstance(n, int) else n
    if unit == "second":
        return F.timestamp_micros(F.unix_micros(t) + n * F.lit(1_000_000).cast("long"))
    date = F.add_months(F.to_date(t), n.cast("int"))
    return F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t)))


put("shifttime", lambda d, text: _timed(d, shifted(T, *increment(text))))


@op("settaxis")
def settaxis(d: Dataset, date: str, time: str = "00:00:00", inc: str = "0second") -> Dataset:
    own, (n, unit) = d.dense(), increment(inc)
    return _timed(own, shifted(F.lit(f"{date} {time}").cast("timestamp"), F.col("ts") * n, unit))


# Attributes and grid

put("setgatt", lambda d, name, text: d.with_(attrs=d.attrs | {name: text}))


@op("setgatts")
def setgatts(d: Dataset, attrs: dict | str) -> Dataset:
    from isohyet.sources.tables import read_keys

    return d.with_(attrs=d.attrs | (read_keys(attrs) if isinstance(attrs, str) else attrs))


def as_grid(grid: Grid | str) -> Grid:
    return named(grid) if isinstance(grid, str) else grid


@op("setgrid")
def setgrid(d: Dataset, grid: Grid | str) -> Dataset:
    new = as_grid(grid)
    if new.size != d.grid.size:
        raise ValueError(f"the grid has {new.size} cells, the data {d.grid.size}")
    if new.nx == d.grid.nx:
        return d.with_(grid=new)
    i = F.col("y") * d.grid.nx + F.col("x")
    return d.of(d.cells.withColumns({"x": (i % new.nx).cast("int"), "y": F.floor(i / new.nx).cast("int")}), grid=new)


put("setgridtype", lambda d, kind: d.with_(grid=d.grid.with_(kind=kind)))
put("setgridarea", lambda d, areas: d.with_(grid=d.grid.with_(areas=tuple(areas) if not isinstance(areas, Dataset) else _field_values(areas))))
put("setgridmask", lambda d, mask: d.with_(grid=d.grid.with_(mask=tuple(mask) if not isinstance(mask, Dataset) else tuple(int(v) for v in _field_values(mask)))))
put("unsetgridmask", lambda d: d.with_(grid=d.grid.with_(mask=None)))
put("setgridnumber", lambda d, number, position=1: d.with_(grid=d.grid.with_(attrs=d.grid.attrs | {"number": int(number), "position": int(position)})))
put("setgriduri", lambda d, uri: d.with_(grid=d.grid.with_(attrs=d.grid.attrs | {"uri": uri})))
put("setzaxis", lambda d, *levels: _set_levels(d, [float(z) for z in levels]))


def _field_values(d: Dataset) -> tuple[float, ...]:
    """One field's values in cell order; a field of a grid that is described on the driver anyway."""
    rows = d.cells.select("x", "y", "v").orderBy("y", "x").limit(d.grid.size).collect()
    return tuple(r["v"] for r in rows)


def _set_levels(d: Dataset, levels: list[float]) -> Dataset:
    from pyspark.sql import Window as W

    axis = d.cells.select("level").distinct().withColumn("_i", F.row_number().over(W.orderBy("level")))
    new = F.element_at(F.lit(levels), F.col("_i"))
    return d.of(d.cells.join(axis.select("level", new.alias("_new")), "level").withColumn("level", F.col("_new")))


def _flipped(d: Dataset, axis: str, data: bool, coordinates: bool) -> Dataset:
    n = d.grid.nx if axis == "x" else d.grid.ny
    out = d.of(d.cells.withColumn(axis, (F.lit(n - 1) - F.col(axis)).cast("int"))) if data else d
    if not coordinates:
        return out
    key = "lons" if axis == "x" else "lats"
    return out.with_(grid=d.grid.with_(**{key: getattr(d.grid, key)[::-1]}))


for _n, _axis in (("lat", "y"), ("lon", "x")):
    put(f"invert{_n}", lambda d, a=_axis: _flipped(d, a, True, True))
    put(f"invert{_n}des", lambda d, a=_axis: _flipped(d, a, False, True))
    put(f"invert{_n}data", lambda d, a=_axis: _flipped(d, a, True, False))


@op("invertlev")
def invertlev(d: Dataset) -> Dataset:
    """The values of the levels in reverse order."""
    from pyspark.sql import Window as W

    axis = d.cells.select("var", "level").distinct()
    n = F.count(F.lit(1)).over(W.partitionBy("var"))
    axis = axis.withColumn("_i", F.row_number().over(W.partitionBy("var").orderBy("level"))).withColumn("_n", n)
    other = axis.select("var", F.col("level").alias("_level"), F.col("_i").alias("_j"))
    both = axis.join(other, "var").where(F.col("_j") == F.col("_n") + 1 - F.col("_i")).select("var", "level", "_level")
    return d.of(d.cells.join(F.broadcast(both) if len(d.variables) <= 10_000 else both, ["var", "level"]).withColumn("level", F.col("_level")))


@op("transxy")
def transxy(d: Dataset) -> Dataset:
    return d.of(d.cells.withColumns({"x": F.col("y"), "y": F.col("x")}), grid=d.grid.with_(lons=d.grid.lats, lats=d.grid.lons, areas=None, mask=None))


def _halo(d: Dataset, left: int, right: int) -> Dataset:
    """Columns repeated around: left ones before the first column, right ones behind the last; negative ones cut."""
    left, right, nx = int(left), int(right), d.grid.nx
    x = F.col("x")
    parts = [d.cells.withColumn("x", x + left).where((F.col("x") >= 0) & (F.col("x") < nx + left + min(0, right)))]
    if left > 0:
        parts.append(d.cells.where(x >= nx - left).withColumn("x", x - (nx - left)))
    if right > 0:
        parts.append(d.cells.where(x < right).withColumn("x", x + nx + left))
    lons = list(d.grid.lons)
    lons = [v - 360 for v in lons[nx - left :]] * (left > 0) + lons[max(0, -left) : nx + min(0, right)] + [v + 360 for v in lons[: max(0, right)]]
    return d.of(union([d.with_(cells=p) for p in parts]), grid=d.grid.with_(lons=tuple(lons), mask=None, areas=None))


put("sethalo", _halo)


@op("tpnhalo")
def tpnhalo(d: Dataset) -> Dataset:
    """Two rows are put north of a tripolar grid: its two top rows, mirrored."""
    nx, x, y = d.grid.nx, F.col("x"), F.col("y")
    top = d.cells.where(y < 2).withColumns({"x": (F.lit(nx - 1) - x).cast("int"), "y": (F.lit(1) - y).cast("int")})
    below = d.cells.withColumn("y", y + 2)
    step = d.grid.lats[1] - d.grid.lats[0] if d.grid.ny > 1 else 1.0
    lats = (d.grid.lats[0] - 2 * step, d.grid.lats[0] - step, *d.grid.lats)
    return d.of(union([d.with_(cells=top), d.with_(cells=below)]), grid=d.grid.with_(lats=lats, mask=None, areas=None))


@op("pardup")
def pardup(d: Dataset, n: int = 2) -> Dataset:
    """Every variable n times, the copies with a number in the name."""
    return _copies(d, int(n))


@op("parmul")
def parmul(d: Dataset, n: int = 2) -> Dataset:
    return _copies(d, int(n))


def _copies(d: Dataset, n: int) -> Dataset:
    names = F.array(*[F.concat(F.col("var"), F.lit(f"_{k}" if k else "")) for k in range(n)])
    metas = {f"{v}_{k}" if k else v: m for v, m in d.variables.items() for k in range(n)}
    return d.of(d.cells.withColumn("_n", F.explode(names)).withColumn("var", F.col("_n")), variables=metas).with_(single=d.single - {"var"})


@op("enlarge")
def enlarge(d: Dataset, grid: Grid | str) -> Dataset:
    """A row is repeated over all rows, a column over all columns; else the last cell fills up."""
    new = as_grid(grid)
    nx, ny = d.grid.nx, d.grid.ny
    if nx == new.nx and ny == 1 and new.ny > 1:
        cells = d.cells.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(new.ny - 1))))
    elif ny == new.ny and nx == 1 and new.nx > 1:
        cells = d.cells.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(new.nx - 1))))
    else:
        old, i = nx * ny, F.col("y") * nx + F.col("x")
        cells = d.cells.withColumn("_i", F.explode(F.when(i == old - 1, F.sequence(i, F.lit(new.size - 1))).otherwise(F.array(i))))
        cells = cells.withColumns({"x": (F.col("_i") % new.nx).cast("int"), "y": F.floor(F.col("_i") / new.nx).cast("int")})
    return d.of(cells, grid=new)


@op("enlargegrid")
def enlargegrid(d: Dataset, grid: Grid | str) -> Dataset:
    """The field within a larger grid that holds all its coordinates; other cells are missing."""
    new = as_grid(grid)
    at = lambda c, own, other: F.element_at(F.lit([min(range(len(other)), key=lambda j: abs(other[j] - v)) for v in own]), (F.col(c) + 1).cast("int"))
    own = d.cells.withColumns({"x": at("x", d.grid.lons, new.lons), "y": at("y", d.grid.lats, new.lats)})
    fields = d.cells.select("var", "level", "ts", "t").distinct()
    full = fields.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(new.nx - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(new.ny - 1))))
    return d.of(full.join(own.drop("t"), ["var", "level", "ts", "x", "y"], "left"), grid=new)


@op("gengrid")
def gengrid(lons: Dataset, lats: Dataset) -> Grid:
    """A grid of the longitudes of the first field's first row and the latitudes of the second's first column."""
    lon = [r["v"] for r in lons.cells.where("y = 0").select("x", "v").distinct().orderBy("x").collect()]
    lat = [r["v"] for r in lats.cells.where("x = 0").select("y", "v").distinct().orderBy("y").collect()]
    return Grid(tuple(lon), tuple(lat))


def _surface(name: str, value: Callable[[Column, Column], Column]) -> None:
    """The named variables rewritten by a land mask (second dataset)."""

    def run(d: Dataset, land: Dataset, *names: str) -> Dataset:
        mask = land.cells.select("x", "y", F.col("v").alias("_land")).distinct()
        own = d.cells.join(mask, ["x", "y"], "left")
        chosen = F.col("var").isin(list(names)) if names else F.lit(True)
        return d.of(own.withColumn("v", F.when(chosen, value(F.col("v"), F.col("_land"))).otherwise(F.col("v"))))

    put(name, run, 2)


_surface("change_e5slm", lambda v, land: land)
_surface("change_e5lsm", lambda v, land: (land >= 0.5).cast("double"))
_surface("change_e5mask", lambda v, land: F.when(land < 0.5, F.lit(0.0)).otherwise(v))
