"""Physics of ocean and atmosphere: densities, temperatures, pressure levels, winds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.dataset import Dataset
from isohyet.functions.constants import BRYDEN, STATE
from isohyet.operators.pairs import beside
from isohyet.operators.registry import op, put

V = F.col("v")
GRAVITY, GAS = 9.80665, 287.05
KT = ["ts", "x", "y"]


def poly(coefficients: tuple[float, ...], t: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * t + c
    return out


def density(t: Column, salt: Column, p: Column) -> Column:
    """Sea water: density at pressure p over one less p over the secant bulk modulus."""
    s = F.greatest(salt, F.lit(0.0))
    root = F.sqrt(s * s * s)
    part = {k: poly(c, t) for k, c in STATE.items()}
    surface = part["a"] + s * part["b"] + root * part["c"] + part["d"] * s * s
    modulus = part["e"] + s * part["f"] + root * part["g"] + p * (part["h"] + s * part["i"] + root * part["j"]) + p * p * (part["k"] + s * part["m"])
    return surface / (1 - p / modulus)


def cooling(t: Column, salt: Column, p: Column) -> Column:
    """How much colder water gets when it is lifted from pressure p to the surface."""
    s = salt - 35
    by = {k: poly(c, t) for k, c in BRYDEN.items()}
    return p * (by["a"] + s * by["b"] + p * (by["c"] - by["d"] * s + p * by["e"]))


def in_situ(potential: Column, salt: Column, p: Column) -> Column:
    """The temperature whose potential temperature this is: a start that is linear in t, and one Newton step.

    The potential temperature is a cubic of t; its coefficients come from the tables' powers.
    """
    s = salt - 35
    at = lambda k, n: BRYDEN[k][n] if n < len(BRYDEN[k]) else 0.0
    power = [-(p * (at("a", n) + s * at("b", n) + p * (at("c", n) - at("d", n) * s + p * at("e", n)))) for n in range(4)]
    power[1] = power[1] + 1
    t = (potential - power[0]) / power[1]
    value = power[0] + t * (power[1] + t * (power[2] + t * power[3])) - potential
    slope = power[1] + t * (2 * power[2] + 3 * power[3] * t)
    return t - value / slope


def _wide(d: Dataset, names: tuple[str, ...]) -> DataFrame:
    """The named variables of a level side by side."""
    own = d.cells.where(F.col("var").isin(list(names)))
    return own.groupBy("level", *KT).agg(F.max("t").alias("t"), *[F.max(F.when(F.col("var") == n, V)).alias(f"w_{n}") for n in names])


def _of(name: str) -> Column:
    """A variable's column in _wide."""
    return F.col(f"w_{name}")


def _ocean(name: str, made: str, f: Callable[[Column, Column, Column], Column]) -> None:
    def run(d: Dataset, pressure: float | None = None, temperature: str = "t", salt: str = "s") -> Dataset:
        """Pressure in bar; without one, a tenth of the level in metres."""
        p = F.col("level") / 10 if pressure is None else F.lit(float(pressure))
        own = _wide(d, (temperature, salt)).withColumn("v", f(_of(temperature), _of(salt), p)).withColumn("var", F.lit(made))
        return d.of(own, variables={made: {}}).only("var")

    put(name, run)


_ocean("rhopot", "rhopoto", density)
_ocean("adisit", "to", in_situ)
_ocean("adipot", "tho", lambda t, s, p: t - cooling(t, s, p))


@op("wct")
def wct(temperature: Dataset, wind: Dataset) -> Dataset:
    """Windchill temperature, where the wind reaches 1.39 m/s and it is at most 33 degrees."""
    t, f = V, F.col("w")
    chill = 33 + (t - 33) * (0.478 + 0.237 * (F.sqrt(f * 3.6) - 0.0124 * f * 3.6))
    return temperature.of(beside(temperature, wind).withColumn("v", F.when((f >= 1.39) & (t <= 33), chill)))


@op("hi")
def hi(temperature: Dataset, vapour: Dataset, humidity: Dataset) -> Dataset:
    """Humidity index of temperature (C), vapour pressure (hPa) and relative humidity (%)."""
    both = temperature.with_(cells=beside(temperature, vapour, "e"))
    own = beside(both, humidity, "r")
    index = V + 5 / 9 * (F.col("e") - 10)
    return temperature.of(own.withColumn("v", F.when((V >= 26) & (F.col("r") >= 40), index)))


# Hybrid levels: half pressures a + b ps, of which vct holds all a, then all b


def half_levels(d: Dataset) -> list[tuple[float, float]]:
    n = len(d.vct) // 2
    return list(zip(d.vct[:n], d.vct[n:]))


def _pressures(d: Dataset, ps: str, value: Callable[[Column, int, list], Column], n: int, name: str) -> Dataset:
    halves = half_levels(d)
    surface = d.cells.where(F.col("var") == ps).select(*KT, "t", F.col("v").alias("_ps"))
    rows = F.array(*[F.struct(F.lit(float(k + 1)).alias("level"), value(F.col("_ps"), k, halves).alias("v")) for k in range(n)])
    own = surface.withColumn("_r", F.explode(rows)).select(*KT, "t", "_r.level", "_r.v").withColumn("var", F.lit(name))
    return d.of(own, variables={name: {}}).only("var")


def _half(ps: Column, k: int, halves: list) -> Column:
    return F.lit(float(halves[k][0])) + float(halves[k][1]) * ps


put("pressure_hl", lambda d, ps="ps": _pressures(d, ps, _half, len(half_levels(d)), "pressure"))
put("pressure_fl", lambda d, ps="ps": _pressures(d, ps, lambda p, k, h: (_half(p, k, h) + _half(p, k + 1, h)) / 2, len(half_levels(d)) - 1, "pressure"))
put("deltap", lambda d, ps="ps": _pressures(d, ps, lambda p, k, h: _half(p, k + 1, h) - _half(p, k, h), len(half_levels(d)) - 1, "deltap"))


def _columns(d: Dataset, names: tuple[str, ...]) -> DataFrame:
    """Per step and cell, the column of (level, values of the named variables), from the top down."""
    wide = _wide(d, names)
    return wide.groupBy(*KT).agg(F.max("t").alias("t"), F.array_sort(F.collect_list(F.struct("level", *[_of(n) for n in names]))).alias("_c"))


@op("gheight")
def gheight(d: Dataset, t: str = "t", q: str = "q", ps: str = "ps", geosp: str = "geosp") -> Dataset:
    """Geopotential height: hydrostatic sums upwards from the surface's."""
    halves = half_levels(d)
    n = len(halves) - 1
    surface = d.cells.where(F.col("var").isin(ps, geosp)).groupBy(*KT).agg(F.max(F.when(F.col("var") == ps, V)).alias("_ps"), F.coalesce(F.max(F.when(F.col("var") == geosp, V)), F.lit(0.0)).alias("_g"))
    own = _columns(d, (t, q)).join(surface, KT)
    height, out = F.col("_g") / GRAVITY, []
    for k in range(n - 1, -1, -1):
        layer = F.get("_c", F.lit(k))
        virtual = layer[f"w_{t}"] * (1 + 0.608 * F.coalesce(layer[f"w_{q}"], F.lit(0.0)))
        top = F.greatest(_half(F.col("_ps"), k, halves), F.lit(0.1))
        height = height + GAS / GRAVITY * virtual * F.log(_half(F.col("_ps"), k + 1, halves) / top)
        out.append(F.struct(F.lit(float(k + 1)).alias("level"), height.alias("v")))
    rows = own.withColumn("_r", F.explode(F.array(*out))).select(*KT, "t", "_r.level", "_r.v").withColumn("var", F.lit("zh"))
    return d.of(rows, variables={"zh": {}}).only("var")


LAPSE = 0.0065


@op("sealevelpressure")
def sealevelpressure(d: Dataset, t: str = "t", ps: str = "ps", geosp: str = "geosp") -> Dataset:
    """Surface pressure brought down to sea level, with the lowest layer's temperature and bounds for cold and warm air."""
    halves = half_levels(d)
    n = len(halves) - 1
    low = d.cells.where((F.col("var") == t) & (F.col("level") == float(n))).select(*KT, F.col("v").alias("_t"))
    own = d.cells.where(F.col("var").isin(ps, geosp)).groupBy(*KT).agg(F.max("t").alias("t"), F.max(F.when(F.col("var") == ps, V)).alias("_ps"), F.max(F.when(F.col("var") == geosp, V)).alias("_g")).join(low, KT)
    half, full = _half(F.col("_ps"), n, halves), (_half(F.col("_ps"), n - 1, halves) + _half(F.col("_ps"), n, halves)) / 2
    alpha = GAS * LAPSE / GRAVITY
    star = (1 + alpha * (half / full - 1)) * F.col("_t")
    star = F.when(star < 255, (255 + star) / 2).otherwise(star)
    own = own.withColumn("_s", star).withColumn("_m", F.col("_s") + LAPSE / GRAVITY * F.col("_g"))
    warm = (F.col("_m") > 290.5) & (F.col("_s") > 290.5)
    own = own.withColumn("_s2", F.when(warm, (290.5 + F.col("_s")) / 2).otherwise(F.col("_s"))).withColumn("_m2", F.when(warm, F.col("_s2")).when((F.col("_m") > 290.5) & (F.col("_s") <= 290.5), F.lit(290.5)).otherwise(F.col("_m")))
    x = F.col("_g") / (GAS * F.col("_s2"))
    a = GAS * (F.col("_m2") - F.col("_s2")) / F.nullif(F.col("_g"), F.lit(0.0))
    y = F.coalesce(a, F.lit(0.0)) * x
    v = F.when(F.abs(F.col("_g")) < 1e-4, half).otherwise(half * F.exp(x * (1 - y / 2 + y * y / 3)))
    return d.of(own.withColumn("v", v).withColumns({"var": F.lit("psl"), "level": F.lit(0.0)}), variables={"psl": {}}).only("var", "level")


# From model levels to pressure or height


def _below_lowest(own: DataFrame, p: Column, half: Column, full: Column, geopotential: Column, temperature: Column, wanted: Column) -> tuple[DataFrame, Column]:
    """Temperature below the lowest full level: to the ground linear towards the surface's, below it along a lapse rate.

    The surface's temperature follows the standard lapse rate from the lowest level; it is drawn to
    255 K when cold, and to 290.5 K when it and its sea level value are warm. Below ground the lapse
    rate is that from the surface to sea level, whose temperature is held to 298 K over high terrain.
    Its parts are columns of *own*, set where *wanted*: one expression repeats them until it is too long to be compiled.
    """
    height = geopotential / GRAVITY
    mild, surface, sea = F.col("_mild"), F.col("_surface"), F.col("_sea")
    own = own.withColumn("_surface", F.when(wanted, (1 + GAS * LAPSE / GRAVITY * (half / full - 1)) * temperature))
    own = own.withColumn("_mild", F.when(surface < 255, (255 + surface) / 2).otherwise(surface))
    own = own.withColumn("_mild", F.when((mild > 290.5) & (mild + LAPSE * height > 290.5), (290.5 + mild) / 2).otherwise(mild))
    above_ground = ((half - p) * temperature + (p - full) * mild) / (half - full)
    own = own.withColumn("_sea", surface + LAPSE * height)
    held = F.when(height < 2500, 0.002 * ((2500 - height) * sea + (height - 2000) * 298)).otherwise(298.0)
    own = own.withColumn("_sea", F.when((height > 2000) & (sea > 298), held).otherwise(sea))
    rate = F.when(sea - surface < 1e-6, 0.0).when(F.abs(geopotential) > 1e-4, GAS * (sea - surface) / geopotential).otherwise(GAS * LAPSE / GRAVITY)
    own = own.withColumn("_x", F.when(wanted & (p > half), rate * F.log(p / half)))
    x = F.col("_x")
    return own, F.when(p <= half, above_ground).otherwise(surface * (1 + x * (1 + x * (0.5 + x / 6))))


def _onto(name: str, heights: bool, extrapolate: bool, logarithmic: bool, from_pressure: bool) -> None:
    def run(d: Dataset, *levels: float, ps: str = "ps", pressure: str = "pressure", geosp: str = "geosp", temperature: str = "t", deltap: str = "deltap") -> Dataset:
        """Linear in the coordinate between full levels, and on from the upper two above them.

        Below the lowest full level its value holds; temperature from model levels is extrapolated there. Below
        ground values are missing, unless extrapolating. Surface pressure: of *ps*; from pressure levels
        the sum of *deltap*, or 110000 Pa without one.
        """
        targets = [float(z) for z in levels]
        if logarithmic and extrapolate and not from_pressure and temperature in d.variables:
            raise ValueError("temperature has no logarithmic extrapolation")
        named = lambda n: F.max(F.when(F.col("var") == n, V))
        at = F.log if logarithmic else lambda p: p
        data = d.cells.where(~F.col("var").isin(ps, pressure, geosp, deltap))
        if from_pressure:
            # the pressures of a column as a map by level, so that it meets the data by step and cell only
            entry = F.collect_list(F.when(F.col("var") == pressure, F.struct("level", "v")))
            own = d.cells.where(F.col("var").isin(pressure, deltap)).groupBy(*KT).agg(F.map_from_entries(entry).alias("_m"), F.coalesce(F.sum(F.when(F.col("var") == deltap, V)), F.lit(110000.0)).alias("_ps"), F.lit(0.0).alias("_g"))
            there, full = F.map_contains_key("_m", F.col("level")), F.try_element_at("_m", F.col("level"))
        else:
            own = d.cells.where(F.col("var").isin(ps, geosp)).groupBy(*KT).agg(named(ps).alias("_ps"), F.coalesce(named(geosp), F.lit(0.0)).alias("_g"))
            halves, k = half_levels(d), F.col("level").cast("int")
            there = F.col("level").isin([float(k + 1) for k in range(len(halves) - 1)])
            table = [F.lit(list(map(float, c))) for c in zip(*halves)]
            half = lambda k: F.get(table[0], k) + F.get(table[1], k) * F.col("_ps")
            full = (half(k - 1) + half(k)) / 2
        rows = data.join(own, KT).where(there).select("var", *KT, "t", at(F.col("_ps")).alias("_ps"), "_g", at(full).alias("_p"), "v")
        cols = rows.groupBy("var", *KT).agg(F.max("t").alias("t"), F.max("_ps").alias("_ps"), F.max("_g").alias("_g"), F.sort_array(F.collect_list(F.struct(F.col("_p").alias("p"), "v"))).alias("_c"))
        # heights follow from pressure in a fixed atmosphere: -7000 log(p / p0)
        goal = [101325.0 * math.exp(-z / 7000.0) for z in targets] if heights else targets
        each = cols.withColumn("_z", F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(math.log(p) if logarithmic else p).alias("p")) for z, p in zip(targets, goal)])))
        p, upper = F.col("_z.p"), F.col("_k")
        # a column of its own, as filters in an expression are worked out wherever they stand
        each = each.withColumn("_k", F.greatest(F.size(F.filter("_c", lambda c: c["p"] < p)) - 1, F.lit(0)))
        pair = {"_p": F.get("_c", upper)["p"], "_v": F.get("_c", upper)["v"], "_p2": F.get("_c", upper + 1)["p"], "_v2": F.get("_c", upper + 1)["v"]}
        each = each.select("var", *KT, "t", "_ps", "_g", "_z", (upper + 1 >= F.size("_c")).alias("_last"), *[c.alias(name) for name, c in pair.items()])
        a, b = F.col("_p"), F.col("_p2")
        inside = F.col("_v") + (p - a) * (F.col("_v2") - F.col("_v")) / (b - a)
        lowest = F.col("_v")
        if not from_pressure:
            warm = F.col("_last") & (F.col("var") == temperature)
            warm = warm if extrapolate else warm & (p <= F.col("_ps"))
            each, below = _below_lowest(each, p, F.col("_ps"), a, F.col("_g"), F.col("_v"), warm)
            lowest = F.when(F.col("var") == temperature, below).otherwise(F.col("_v"))
        v = F.when(F.col("_last"), lowest).otherwise(inside)
        v = v if extrapolate else F.when(p <= F.col("_ps"), v)
        return d.of(each.withColumn("v", v).withColumn("level", F.col("_z.z")))

    put(name, run)


for _log in ("", "_lp"):
    for _x in ("", "x"):
        _onto(f"ml2pl{_x}{_log}", False, bool(_x), bool(_log), False)
        _onto(f"ml2hl{_x}{_log}", True, bool(_x), bool(_log), False)
        _onto(f"ap2pl{_x}{_log}", False, bool(_x), bool(_log), True)


def _eta(name: str) -> None:
    def run(d: Dataset, vct: tuple[float, ...], ps: str = "ps") -> Dataset:
        """Hybrid levels of another coordinate table, linear in pressure, the ends kept."""
        new = d.with_(vct=tuple(map(float, vct)))
        halves, target = half_levels(d), half_levels(new)
        full = lambda h: [((_half(F.col("_ps"), k, h) + _half(F.col("_ps"), k + 1, h)) / 2) for k in range(len(h) - 1)]
        surface = d.cells.where(F.col("var") == ps).select(*KT, F.col("v").alias("_ps"))
        cols = d.cells.where(F.col("var") != ps).groupBy("var", *KT).agg(F.max("t").alias("t"), F.array_sort(F.collect_list(F.struct("level", "v"))).alias("_c")).join(surface, KT)
        cols = cols.withColumn("_f", F.arrays_zip(F.array(*full(halves)).alias("p"), F.transform("_c", lambda c: c["v"]).alias("v")))
        each = cols.withColumn("_z", F.explode(F.array(*[F.struct(F.lit(float(k + 1)).alias("z"), p.alias("p")) for k, p in enumerate(full(target))])))
        p = F.col("_z.p")
        above, below = F.filter("_f", lambda c: c["p"] <= p), F.filter("_f", lambda c: c["p"] >= p)
        a, b = F.get(above, F.size(above) - 1), F.get(below, F.lit(0))
        share = F.coalesce((p - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0.0)), F.lit(0.0))
        v = F.when(F.size(above) == 0, b["v"]).when(F.size(below) == 0, a["v"]).otherwise(a["v"] * (1 - share) + b["v"] * share)
        return new.of(each.withColumn("v", v).withColumn("level", F.col("_z.z")))

    put(name, run)


for _n in ("remapeta", "remapeta_s", "remapeta_z"):
    _eta(_n)


@op("vertwind")
def vertwind(d: Dataset, t: str = "t", q: str = "q", omega: str = "omega", pressure: str = "pressure") -> Dataset:
    """Vertical velocity in m/s: omega over g and the density of moist air. Pressure from a variable or the level."""
    names = (t, q, omega)
    own = _wide(d, (*names, pressure))
    p = F.coalesce(_of(pressure), F.col("level"))
    rho = p / (GAS * _of(t) * (1 + 0.608 * _of(q)))
    return d.of(own.withColumn("v", _of(omega) / (GRAVITY * rho)).withColumn("var", F.lit("wz")), variables={"wz": {}}).only("var")


@op("mastrfu")
def mastrfu(d: Dataset) -> Dataset:
    """Mass stream function of zonal mean v on pressure levels: trapezoids from the top of the level list."""
    fact = math.pi * 6371000.0 / GRAVITY
    own = d.cells.groupBy("var", *KT).agg(F.max("t").alias("t"), F.array_sort(F.collect_list(F.struct(F.col("level").alias("p"), "v")), lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0)).alias("_c"))
    own = own.withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_c") - 1)))
    rest = F.slice("_c", F.col("_k") + 1, F.size("_c"))
    steps = F.zip_with(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), F.slice(rest, 2, F.size(rest)), lambda a, b: fact * (a["v"] + b["v"]) * (a["p"] - b["p"]))
    v = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) * F.cos(F.radians(d.lat()))
    return d.of(own.withColumn("v", v).withColumn("level", F.get("_c", F.col("_k"))["p"]))


def _within(low: float, high: float) -> Callable[[Column], Column]:
    return lambda c: (c["level"] >= low) & (c["level"] < high)


@op("cloudlayer")
def cloudlayer(d: Dataset, cover: str = "aclcac") -> Dataset:
    """High, mid and low cloud cover with random overlap: pressure levels above 440 hPa, to 680 hPa, below."""
    bands = ((33, 0.0, 44000.0), (34, 44000.0, 68000.0), (35, 68000.0, 1e9))
    cols = d.cells.where(F.col("var") == cover).groupBy(*KT).agg(F.max("t").alias("t"), F.array_sort(F.collect_list(F.struct("level", "v"))).alias("_c"))
    rows = []
    for code, low, high in bands:
        own = F.filter("_c", _within(low, high))
        state = F.struct(F.lit(1.0).alias("clear"), F.lit(0.0).alias("last"))
        clear = F.aggregate(own, state, lambda s, c: F.struct((s["clear"] * (1 - F.greatest(s["last"], c["v"])) / (1 - F.least(s["last"], F.lit(1 - 1e-12)))).alias("clear"), c["v"].alias("last")), lambda s: s["clear"])
        rows.append(F.struct(F.lit(f"var{code}").alias("var"), (1 - clear).alias("v")))
    own = cols.withColumn("_r", F.explode(F.array(*rows))).select(*KT, "t", "_r.var", "_r.v").withColumn("level", F.lit(0.0))
    return d.of(own, variables={f"var{c}": {"code": c} for c, _, _ in bands}).only("level")


# Rotated winds


@op("rotuvb")
def rotuvb(d: Dataset, *pairs: str, lon_pole: float = -170.0, lat_pole: float = 35.0) -> Dataset:
    """Wind components of a rotated grid turned back to true east and north, pairs of names after another."""
    lat0, lon0 = math.radians(lat_pole), math.radians(lon_pole)
    rlon, rlat = F.radians(d.lon()), F.radians(d.lat())
    # true position of a rotated one
    sin_lat = F.sin(F.lit(lat0)) * F.sin(rlat) + F.cos(F.lit(lat0)) * F.cos(rlat) * F.cos(rlon)
    lat = F.asin(F.least(F.greatest(sin_lat, F.lit(-1.0)), F.lit(1.0)))
    a = math.sin(lon0) * (-math.sin(lat0) * F.cos(rlon) * F.cos(rlat) + math.cos(lat0) * F.sin(rlat)) - math.cos(lon0) * F.sin(rlon) * F.cos(rlat)
    b = math.cos(lon0) * (-math.sin(lat0) * F.cos(rlon) * F.cos(rlat) + math.cos(lat0) * F.sin(rlat)) + math.sin(lon0) * F.sin(rlon) * F.cos(rlat)
    lon = F.atan2(a, b)
    # angle between the meridians of both systems
    s = math.cos(lat0) * F.sin(lon0 - lon)
    c = F.cos(lat) * math.sin(lat0) - F.sin(lat) * math.cos(lat0) * F.cos(lon0 - lon)
    size = F.sqrt(s * s + c * c)
    s, c = s / size, c / size
    out = d.cells.where(~F.col("var").isin(list(pairs))).select("var", "level", *KT, "t", "v")
    for u, v in zip(pairs[::2], pairs[1::2]):
        own = _wide(d, (u, v))
        turned = F.explode(F.array(F.struct(F.lit(u).alias("var"), (_of(u) * c + _of(v) * s).alias("v")), F.struct(F.lit(v).alias("var"), (_of(v) * c - _of(u) * s).alias("v"))))
        out = out.unionByName(own.withColumn("_r", turned).select("_r.var", "level", *KT, "t", "_r.v"))
    return d.of(out)


def _axes(d: Dataset) -> tuple[Column, Column, Column, Column]:
    """Components along east and north of the grid's x and y directions, from the rows' and columns' spacing."""
    g = d.grid
    lat = F.radians(d.lat())
    ex = F.signum(F.lit((g.lons[-1] - g.lons[0]) or 1.0)) * F.cos(lat) / F.nullif(F.cos(lat), F.lit(0.0))
    ny = F.signum(F.lit((g.lats[-1] - g.lats[0]) or 1.0))
    return ex, F.lit(0.0), F.lit(0.0), ny


def _grid_wind(name: str) -> None:
    def run(d: Dataset, u: str = "u", v: str = "v") -> Dataset:
        """Wind along the grid's axes, its length kept; on regular grids the axes are east and north up to sign."""
        a, b, c, e = _axes(d)
        own = _wide(d, (u, v))
        x, y = _of(u) * a + _of(v) * b, _of(u) * c + _of(v) * e
        length, now = F.sqrt(_of(u) ** 2 + _of(v) ** 2), F.sqrt(x * x + y * y)
        scale = F.when(now > 0, length / now).otherwise(1.0)
        rows = F.explode(F.array(F.struct(F.lit(u).alias("var"), (x * scale).alias("v")), F.struct(F.lit(v).alias("var"), (y * scale).alias("v"))))
        return d.of(own.withColumn("_r", rows).select("_r.var", "level", *KT, "t", "_r.v"))

    put(name, run)


for _n in ("mrotuv", "mrotuvb"):
    _grid_wind(_n)


@op("complextorect")
def complextorect(d: Dataset, imaginary: Dataset | None = None) -> tuple[Dataset, Dataset]:
    """Real and imaginary parts; a complex field is a pair of datasets here."""
    return d, imaginary if imaginary is not None else d.map(F.when(V.isNotNull(), F.lit(0.0)))


@op("complextopol")
def complextopol(re: Dataset, im: Dataset) -> tuple[Dataset, Dataset]:
    own = beside(re, im)
    return re.of(own.withColumn("v", F.hypot(V, F.col("w")))), re.of(own.withColumn("v", F.atan2(F.col("w"), V)))


@op("imtocomplex")
def imtocomplex(d: Dataset) -> tuple[Dataset, Dataset]:
    return d.map(F.when(V.isNotNull(), F.lit(0.0))), d


