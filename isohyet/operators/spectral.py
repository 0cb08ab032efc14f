"""Fourier analysis and filters along time, empirical orthogonal functions, spherical harmonics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.dataset import SERIES, Dataset, apply_in_groups
from isohyet.functions.kernels import RADIUS, added_rows, detrended, dv_to_uv, from_fourier, from_spectral, passband, products, resized, stacked, symmetric, taper, to_fourier, to_spectral, unstacked, uv_to_dv
from isohyet.grid import Grid, gaussian_latitudes
from isohyet.operators.modify import as_grid
from isohyet.operators.registry import op, put
from isohyet.operators.stats import middle

V = F.col("v")
FEW = 1024  # cells whose matrix is made whatever the number of steps
BLOCK = 65_536  # cells of the fields that go to Python together


def by_series(d: Dataset, f) -> Dataset:  # noqa: ANN001
    """Each whole series through a numpy function of equal length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pdf.assign(v=f(pdf["v"].to_numpy(float)))

    return d.of(apply_in_groups(d.cells, SERIES, run))


def _filter(d: Dataset, low: float | None, high: float | None, rate: float = 365.0) -> Dataset:
    """Frequencies in cycles a year; rate: steps a year. Missing values are an error."""

    def one(v: np.ndarray) -> np.ndarray:
        if np.isnan(v).any():
            raise ValueError("missing values cannot be filtered")
        mask = passband(len(v), float(low or 0), float(high) if high is not None else rate, float(rate))
        return np.fft.ifft(np.fft.fft(v) * mask).real

    return by_series(d, one)


put("bandpass", lambda d, low, high, rate=365.0: _filter(d, low, high, rate))
put("highpass", lambda d, low, rate=365.0: _filter(d, low, None, rate))
put("lowpass", lambda d, high, rate=365.0: _filter(d, None, high, rate))


@op("fourier")
def fourier(re: Dataset, sign: int = -1, im: Dataset | None = None) -> tuple[Dataset, Dataset]:
    """Complex transform over time, over the square root of the length: real and imaginary parts."""
    sign = int(sign)
    cells = re.cells.withColumn("w", F.lit(0.0)) if im is None else re.cells.join(im.cells.select("var", "level", "ts", "x", "y", F.col("v").alias("w")), ["var", "level", "ts", "x", "y"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        z = pdf["v"].to_numpy(float) + 1j * pdf["w"].to_numpy(float)
        f = (np.fft.fft(z) if sign < 0 else np.fft.ifft(z) * len(z)) / math.sqrt(len(z))
        return pdf.assign(v=f.real, w=f.imag)

    out = apply_in_groups(cells, SERIES, run, ", w double")
    return re.of(out), re.of(out.withColumn("v", F.col("w")))


@op("harmonic")
def harmonic(d: Dataset, n_out: int, n: int) -> list[Dataset]:
    """Amplitudes of the first n_out harmonics of a period of n steps, as sums of sines and cosines."""
    n_out, n = int(n_out), int(n)
    parts = []
    for k in range(1, n_out + 1):
        turn = 2 * math.pi * (((F.col("ts") + 1) * k) % n) / n
        parts += [F.sum(V * F.sin(turn)).alias(f"s{k}"), F.sum(V * F.cos(turn)).alias(f"c{k}")]
    sums = d.dense().cells.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), middle(F.min("t"), F.max("t")).alias("t"), *parts).withColumn("ts", F.lit(0))
    out = []
    for k in range(1, n_out + 1):
        v = F.col(f"c{k}") / F.col("n") if 2 * k == n else F.sqrt(F.col(f"s{k}") ** 2 + F.col(f"c{k}") ** 2) * 2 / F.col("n")
        out.append(d.of(sums.withColumn("v", v)).only("ts"))
    return out


@op("spectrum")
def spectrum(d: Dataset, detrend: int = 0, segments: int = 1, length: int | None = None, window: str = "none") -> Dataset:
    """Power by frequency, averaged over overlapping segments; detrend 0 none, 1 mean, 2 line, 3 line by segment.

    Frequencies become steps 0, 1, 2 ...
    """
    detrend, segments = int(detrend), int(segments)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        v = pdf["v"].to_numpy(float)
        seg = int(length or len(v))
        v = v - v.mean() if detrend == 1 else detrended(v) if detrend == 2 else v
        w = taper(window, seg)
        total = np.zeros(seg // 2 + 1)
        for i in range(segments):
            at = 0 if segments == 1 else int((len(v) - seg) / (segments - 1) * i)
            part = v[at : at + seg]
            part = (detrended(part) if detrend == 3 else part) * w
            power = np.abs(np.fft.fft(part)) ** 2 / seg
            total[0] += power[0]
            half = (seg + 1) // 2
            total[1:half] += power[1:half] + power[: seg - half : -1]
            if seg % 2 == 0:
                total[seg // 2] += power[seg // 2]
        total *= seg / (segments * (w * w).sum() * seg)
        total[0] *= 2
        if seg % 2 == 0:
            total[seg // 2] *= 2
        out = pdf.iloc[np.zeros(len(total), int)]
        return out.assign(ts=np.arange(len(total)), v=total)

    return d.of(apply_in_groups(d.cells, SERIES, run))


# Empirical orthogonal functions


def _gram(vectors: DataFrame, group: list[str]) -> DataFrame:
    """Sums of w x' x over vectors with w, positions at and values v: rows at of a symmetric matrix for each group, as arrays g.

    Each task adds its vectors up in one matrix at a time, then matrices are added row by row.
    """
    shape = f"{_kinds(group)}, at int, g array<double>"
    parts = vectors.sortWithinPartitions(*group).mapInPandas(lambda frames: products(frames, group), shape)
    return parts.groupBy(*group, "at").applyInPandas(added_rows, shape)


def _kinds(group: list[str]) -> str:
    return ", ".join({"var": "var string", "level": "level double"}[c] for c in group)


def _vectors(own: DataFrame, group: list[str], by: list[str], at: Column, w: Column) -> DataFrame:
    """own's values gathered by some of its columns, each with its position."""
    lists = own.groupBy(*group, *by).agg(F.collect_list(F.struct(at.cast("int").alias("at"), "v")).alias("s"), F.first(w).alias("w"))
    return lists.select(*group, "w", F.col("s.at").alias("at"), F.col("s.v").alias("v"))


def eof(d: Dataset, n: int, three: bool = False, weights: bool = True) -> tuple[Dataset, Dataset]:
    """Eigenvalues and patterns of the covariance between cells (or levels and cells); data are not centred.

    The matrix is one of cells or one of steps, whichever are fewer, as both have the same eigenvalues other
    than 0; up to FEW cells nothing is counted for that. A task holds one such matrix. Patterns have unit
    weighted norm, and the sign that makes their largest value positive.
    """
    n = int(n)
    group = ["var"] if three else ["var", "level"]
    cell = ["level", "x", "y"] if three else ["x", "y"]
    levels = sorted(r[0] for r in d.cells.select("level").distinct().collect()) if three and "level" not in d.single else []
    size = d.grid.size * max(1, len(levels))
    cells = d.cells.withColumn("_w", d.grid.weight() if weights else F.lit(1.0))
    axis = d.steps()
    span = axis.agg(F.min("ts").alias("_first"), F.count(F.lit(1)).alias("_steps"))
    places = cells.join(F.broadcast(span)).groupBy(*group, *cell).agg(F.first("_w").alias("_w"), F.first("_steps").alias("_steps"), F.max("t").alias("t"), F.count("v").alias("_n"), F.count(F.when(F.col("ts") == F.col("_first"), V)).alias("_begun"))
    total = places.groupBy(*group).agg(F.max("t").alias("t"), F.max("_steps").alias("_steps"), F.sum(F.when(F.col("_begun") > 0, F.col("_w"))).alias("_sw"))
    stamp = total.select(*group, "t")
    kinds = _kinds(group)
    if size <= FEW or size <= axis.count():
        at = F.col("y") * d.grid.nx + F.col("x") + ((F.array_position(F.lit(levels), F.col("level")) - 1) * d.grid.size if levels else 0)
        gram = _gram(_vectors(cells.where(V.isNotNull()), group, ["ts"], at, F.lit(1.0)), group)
        own = places.where("_n > 0").select(*group, *[c for c in cell if c not in group], "_w", at.cast("int").alias("at"))

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            """Of cells: a pattern is the sum of steps, each times its share in the eigenvector."""
            at, root, steps = pdf["at"].to_numpy(), np.sqrt(pdf["_w"].to_numpy()), int(pdf["_steps"].iloc[0])
            g = symmetric(pdf["at"], pdf["g"])[np.ix_(at, at)]
            value, vector = np.linalg.eigh(g * root * root[:, None] / (float(pdf["_sw"].iloc[0]) * steps))
            best = np.argsort(-value)[: min(n, steps)]
            return pd.concat([pd.DataFrame({**{c: pdf[c].iloc[0] for c in group}, "eof": k, "value": value[o], "at": at, "p": g @ (root * vector[:, o])}) for k, o in enumerate(best)])

        found = gram.join(own.select(*group, "at", "_w"), [*group, "at"]).join(total, group).drop("t").groupBy(*group).applyInPandas(solve, f"{kinds}, eof int, value double, at int, p double")
        raw = found.join(own, [*group, "at"])
    else:
        own = d.dense().cells.where(V.isNotNull()).drop("t").withColumn("_w", d.grid.weight() if weights else F.lit(1.0))
        gram = _gram(_vectors(own, group, cell, F.col("ts"), F.col("_w")), group)

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            """Of steps: shares of the steps in a pattern."""
            steps = int(pdf["_steps"].iloc[0])
            value, vector = np.linalg.eigh(symmetric(pdf["at"], pdf["g"]) / (float(pdf["_sw"].iloc[0]) * steps))
            best = np.argsort(-value)[: min(n, steps)]
            return pd.concat([pd.DataFrame({**{c: pdf[c].iloc[0] for c in group}, "eof": k, "value": value[o], "ts": range(len(value)), "c": vector[:, o]}) for k, o in enumerate(best)])

        found = gram.join(total, group).drop("t").groupBy(*group).applyInPandas(solve, f"{kinds}, eof int, value double, ts int, c double")
        raw = own.join(found.select(*group, "ts", "eof", "c"), [*group, "ts"]).groupBy(*group, *cell, "eof").agg(F.sum(V * F.col("c")).alias("p"), F.first("_w").alias("_w"))
    place = {"x": F.lit(0), "y": F.lit(0)} | ({"level": F.lit(0.0)} if three else {})
    values = found.select(*group, "eof", "value").distinct().join(stamp, group).withColumns(place | {"ts": F.col("eof"), "v": F.col("value")})
    norm = raw.groupBy(*group, "eof").agg(F.sqrt(F.sum(F.col("_w") * F.col("p") ** 2)).alias("_norm"), F.max_by("p", F.abs("p")).alias("_top"), F.sum("_w").alias("_all"))
    scaled = raw.join(norm, [*group, "eof"]).withColumn("v", F.signum("_top") * F.col("p") / F.nullif(F.col("_norm"), F.lit(0.0)) * F.sqrt("_all")).join(stamp, group)
    grid = d.grid.with_(lons=(0.0,), lats=(0.0,), areas=None)
    return d.of(values, grid=grid), d.of(scaled.withColumn("ts", F.col("eof")))


for _n in ("eof", "eofspatial", "eoftime"):
    put(_n, lambda d, n=1, weights="on": eof(d, n, False, weights != "off"))
for _n in ("eof3d", "eof3dspatial", "eof3dtime"):
    put(_n, lambda d, n=1, weights="on": eof(d, n, True, weights != "off"))


def _coefficients(patterns: Dataset, d: Dataset, three: bool) -> Dataset:
    """Sum of value times pattern over the cells, for each step and pattern; patterns become levels."""
    keys = ["var", "x", "y", "level"]
    right = patterns.cells.select(*keys, F.col("ts").alias("eof"), F.col("v").alias("e"))
    group = ["var", "ts", "t", "eof"] + ([] if three else ["level"])
    out = d.cells.join(right, keys).groupBy(*group).agg(F.nullif(F.sum(V * F.col("e")), F.lit(0.0)).alias("v"))
    out = out.withColumns({"x": F.lit(0), "y": F.lit(0), "level": F.col("eof").cast("double")}) if three else out.withColumns({"x": F.lit(0), "y": F.lit(0), "var": F.concat_ws("_", "var", F.col("eof").cast("string"))})
    return d.of(out, grid=d.grid.with_(lons=(0.0,), lats=(0.0,), areas=None))


put("eofcoeff", lambda p, d: _coefficients(p, d, False), 2)
put("eofcoeff3d", lambda p, d: _coefficients(p, d, True), 2)


# Spherical harmonics. Coefficients are cells: y holds the order m, x twice the degree over m, plus one for the imaginary part.


def truncation(grid: Grid, linear: bool = False) -> int:
    """The triangular truncation that belongs to a Gaussian grid."""
    return (grid.ny * 2 - 1) // (2 if linear else 3)


def _block(grid: Grid) -> Column:
    """Steps whose fields are BLOCK cells together, or one."""
    return F.floor(F.col("ts") / max(1, BLOCK // grid.size))


def by_field(d: Dataset, f, grid: Grid) -> Dataset:  # noqa: ANN001
    """Fields as matrices [step, y, x] through a numpy function to other matrices, some steps at once."""
    nx, ny = d.grid.nx, d.grid.ny

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (fields,), steps = stacked(pdf, (pdf["var"].iloc[0],), ny, nx, np.nan)
        return unstacked(f(fields), steps, pdf["var"].iloc[0])

    return d.of(apply_in_groups(d.cells, ["var", "level", _block(d.grid)], run), grid=grid)


def spectral_grid(top: int) -> Grid:
    return Grid(tuple(range(2 * (top + 1))), tuple(range(top + 1)), "spectral", attrs={"truncation": top})


def _gaussian(top: int, linear: bool) -> Grid:
    ny = 2 * ((top + 1 + 1) // 2) if linear else 2 * ((3 * top + 1 + 3) // 4)
    return Grid(tuple(360 / (2 * ny) * i for i in range(2 * ny)), gaussian_latitudes(ny // 2), "gaussian")


def _analysed(d: Dataset, linear: bool) -> Dataset:
    lats, top = d.grid.lats, truncation(d.grid, linear)
    return by_field(d, lambda f: to_spectral(f, lats, top), spectral_grid(top))


def _synthesised(d: Dataset, linear: bool) -> Dataset:
    g = _gaussian(d.grid.ny - 1, linear)
    lats, nx = g.lats, g.nx
    return by_field(d, lambda f: from_spectral(f, lats, nx), g)


for _s, _linear in (("", False), ("l", True)):
    put(f"gp2sp{_s}", lambda d, lin=_linear: _analysed(d, lin))
    put(f"sp2gp{_s}", lambda d, lin=_linear: _synthesised(d, lin))


@op("sp2sp")
def sp2sp(d: Dataset, top: int) -> Dataset:
    top = int(top)
    return by_field(d, lambda c: resized(c, top), spectral_grid(top))


@op("spcut")
def spcut(d: Dataset, *waves: int) -> Dataset:
    """Coefficients of the zonal wave numbers listed become 0."""
    return d.map(F.when(F.col("y").isin([int(w) for w in waves]), F.lit(0.0)).otherwise(V))


# Fourier coefficients along latitudes: cells with x twice the wave number, plus one for the imaginary part.


def _fourier_grid(g: Grid) -> Grid:
    return g.with_(lons=tuple(range(2 * (g.nx // 2 + 1))), kind="fourier")


def _grid_of_fourier(g: Grid) -> Grid:
    nx = 2 * (g.nx // 2 - 1)
    return g.with_(lons=tuple(360 / nx * i for i in range(nx)), kind="gaussian")


put("gp2fc", lambda d: by_field(d, to_fourier, _fourier_grid(d.grid)))
put("fc2gp", lambda d: by_field(d, from_fourier, _grid_of_fourier(d.grid)))


@op("fc2sp")
def fc2sp(d: Dataset) -> Dataset:
    lats, top = d.grid.lats, truncation(d.grid)
    return by_field(d, lambda c: to_spectral(from_fourier(c), lats, top), spectral_grid(top))


@op("sp2fc")
def sp2fc(d: Dataset) -> Dataset:
    g = _gaussian(d.grid.ny - 1, False)
    lats, nx = g.lats, g.nx
    return by_field(d, lambda c: to_fourier(from_spectral(c, lats, nx)), _fourier_grid(g))


def _wind(d: Dataset, names: tuple[str, str], made: tuple[str, str], f, grid: Grid) -> Dataset:  # noqa: ANN001
    """Two variables of a field together through a numpy function to two others, some steps at once."""
    nx, ny = d.grid.nx, d.grid.ny

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fields, steps = stacked(pdf, names, ny, nx, 0.0)
        return pd.concat([unstacked(out, steps, name) for name, out in zip(made, f(*fields))])

    cells = d.cells.where(F.col("var").isin(list(names)))
    return d.of(apply_in_groups(cells, ["level", _block(d.grid)], run), grid=grid, variables={n: {} for n in made})


def _to_divergence(d: Dataset, linear: bool, u: str, v: str) -> Dataset:
    lats, top = d.grid.lats, truncation(d.grid, linear)
    return _wind(d, (u, v), ("sd", "svo"), lambda a, b: uv_to_dv(a, b, lats, top), spectral_grid(top))


def _to_wind(d: Dataset, linear: bool, div: str, vor: str) -> Dataset:
    g = _gaussian(d.grid.ny - 1, linear)
    lats, nx = g.lats, g.nx
    return _wind(d, (div, vor), ("u", "v"), lambda a, b: dv_to_uv(a, b, lats, nx), g)


for _s, _linear in (("", False), ("l", True)):
    put(f"uv2dv{_s}", lambda d, u="u", v="v", lin=_linear: _to_divergence(d, lin, u, v))
    put(f"dv2uv{_s}", lambda d, div="sd", vor="svo", lin=_linear: _to_wind(d, lin, div, vor))


@op("dv2ps")
def dv2ps(d: Dataset, div: str = "sd", vor: str = "svo") -> Dataset:
    """Velocity potential and stream function: coefficients over -n (n + 1) / a^2, a product in each row."""
    n = F.col("y") + F.floor(F.col("x") / 2)
    own = d.map(F.when(n > 0, -V * RADIUS * RADIUS / (n * (n + 1))).otherwise(F.lit(0.0)))
    renamed = F.when(F.col("var") == div, "velopot").when(F.col("var") == vor, "stream")
    return d.of(own.cells.where(F.col("var").isin(div, vor)).withColumn("var", renamed), variables={"velopot": {}, "stream": {}})
