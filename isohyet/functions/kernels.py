"""Numpy kernels over whole series and fields. Free of column expressions, so that workers can import them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

RADIUS = 6371000.0
VECTORS_AT_ONCE = 256  # in a matrix product


def passband(n: int, low: float, high: float, rate: float) -> np.ndarray:
    """Which frequencies pass: from floor(n low / rate) to ceil(n high / rate), on both sides of zero."""
    first = max(0, math.floor(n * low / rate))
    last = min(n // 2, math.ceil(n * high / rate))
    mask = np.zeros(n, bool)
    mask[first : last + 1] = True
    for k in range(max(1, first + 1), last + 1):
        mask[n - k] = True
    return mask


def taper(name: str, n: int) -> np.ndarray:
    k = np.arange(n) + 0.5
    return {
        "none": np.ones(n),
        "hann": 0.5 - 0.5 * np.cos(2 * np.pi * k / n),
        "bartlett": 1 - np.abs(2 * k / n - 1),
        "welch": 1 - (2 * k / n - 1) ** 2,
        "hamming": 0.54 - 0.46 * np.cos(2 * np.pi * k / n),
        "blackman": 0.42 - 0.5 * np.cos(2 * np.pi * k / n) + 0.08 * np.cos(4 * np.pi * k / n),
    }[name]


def detrended(v: np.ndarray) -> np.ndarray:
    k = np.arange(len(v))
    return v - np.polyval(np.polyfit(k, v, 1), k)


def stacked(pdf: pd.DataFrame, names: tuple[str, ...], ny: int, nx: int, fill: float) -> tuple[list[np.ndarray], pd.DataFrame]:
    """The fields [step, y, x] of each of the named variables of a level, and a row a step of what they share."""
    ts, first, at = np.unique(pdf["ts"].to_numpy(), return_index=True, return_inverse=True)
    y, x, v, var = pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["v"].to_numpy(float), pdf["var"].to_numpy()
    fields = []
    for name in names:
        own = var == name
        a = np.full((len(ts), ny, nx), fill)
        a[at[own], y[own], x[own]] = v[own]
        fields.append(a)
    return fields, pdf[["level", "ts", "t"]].iloc[first]


def unstacked(fields: np.ndarray, steps: pd.DataFrame, name: str) -> pd.DataFrame:
    """Rows of fields [step, y, x]."""
    n, ny, nx = fields.shape
    out = steps.iloc[np.repeat(np.arange(n), ny * nx)]
    y, x = np.indices((ny, nx), dtype="int32")
    out = out.assign(var=name, x=np.tile(x.ravel(), n), y=np.tile(y.ravel(), n), v=fields.ravel())
    return out[["var", "level", "ts", "t", "x", "y", "v"]]


def growing_season(v: np.ndarray, late: np.ndarray, n: int, t: float) -> tuple[float, int | None]:
    """Its length in days, and its first day's place in the year whose days these are; late: days of the second half."""
    warm, cold, start = 0, 0, None
    for k, (value, second) in enumerate(zip(v.tolist(), late.tolist())):
        if start is None:
            warm = warm + 1 if value > t else 0
            if warm == n:
                start = k - n + 1
            elif second and warm == 0:
                return 0.0, None
        elif second:
            cold = cold + 1 if value < t else 0
            if cold == n:
                return float(k - n + 1 - start), start
    return (0.0, None) if start is None else (float(len(v) - start - cold), start)


# Symmetric matrices, a row (at, g) each


def products(frames: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Sums of w x' x over rows of w, positions at and values v, which come group by group."""
    held, g = None, np.zeros((0, 0))
    for pdf in frames:
        for key, rows in pdf.groupby(group, sort=False):
            if key != held:
                yield from matrix_rows(group, held, g)
                held, g = key, np.zeros((0, 0))
            size = max(int(a.max()) + 1 for a in rows["at"])
            g = np.pad(g, (0, size - len(g))) if size > len(g) else g
            for first in range(0, len(rows), VECTORS_AT_ONCE):
                part = rows.iloc[first : first + VECTORS_AT_ONCE]
                x = np.zeros((len(part), len(g)))
                for i, (a, v) in enumerate(zip(part["at"], part["v"])):
                    x[i, a] = v
                g += x.T @ (x * part["w"].to_numpy()[:, None])
    yield from matrix_rows(group, held, g)


def matrix_rows(group: list[str], key: tuple | None, g: np.ndarray) -> Iterator[pd.DataFrame]:
    for first in range(0, len(g), VECTORS_AT_ONCE):
        part = g[first : first + VECTORS_AT_ONCE]
        yield pd.DataFrame({**dict(zip(group, key)), "at": range(first, first + len(part)), "g": list(part)})


def added_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of several of the same place; shorter ones end with zeros."""
    out = np.zeros(max(map(len, pdf["g"])))
    for g in pdf["g"]:
        out[: len(g)] += g
    return pdf.iloc[[0]].assign(g=[out])


def symmetric(at: pd.Series, rows: pd.Series) -> np.ndarray:
    """The matrix of its rows; those that are not there are 0."""
    size = max(int(at.max()) + 1, *map(len, rows))
    out = np.zeros((size, size))
    for k, row in zip(at, rows):
        out[k, : len(row)] = row
    return out


# Fields and coefficients: the last two axes are those of one, any before them count several.


@lru_cache(maxsize=8)
def legendre(lats: tuple[float, ...], top: int) -> np.ndarray:
    """Normalised associated functions [m, n, latitude] up to a triangular truncation, by recursion on the degree."""
    mu = np.sin(np.radians(lats))
    p = np.zeros((top + 2, top + 2, len(mu)))
    root = np.sqrt(1 - mu * mu)
    for m in range(top + 2):
        p[m, m] = math.sqrt(0.5) if m == 0 else p[m - 1, m - 1] * root * math.sqrt((2 * m + 1) / (2 * m))
        if m <= top:
            p[m, m + 1] = mu * math.sqrt(2 * m + 3) * p[m, m]
        for n in range(m + 2, top + 2):
            p[m, n] = (mu * p[m, n - 1] - _ratio(m, n - 1) * p[m, n - 2]) / _ratio(m, n)
    return p


def _ratio(m: int, n: int) -> float:
    return math.sqrt((n * n - m * m) / (4 * n * n - 1)) if n else 0.0


def slopes(p: np.ndarray, m: int, top: int) -> np.ndarray:
    """(1 - mu^2) dP/dmu [n, latitude] of the degrees from m on."""
    return np.array([(n + 1) * _ratio(m, n) * p[m, n - 1] * (n > m) - n * _ratio(m, n + 1) * p[m, n + 1] for n in range(m, top + 1)])


@lru_cache(maxsize=8)
def gaussian_nodes(lats: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sines of Gaussian latitudes as given, and their quadrature weights."""
    mu = np.sin(np.radians(lats))
    nodes, w = np.polynomial.legendre.leggauss(len(lats))
    return mu, w[np.argsort(np.argsort(mu))]


def order(c: np.ndarray, m: int) -> np.ndarray:
    n = c.shape[-2] - m
    return c[..., m, 0 : 2 * n : 2] + 1j * c[..., m, 1 : 2 * n : 2]


def put_order(out: np.ndarray, m: int, z: np.ndarray) -> None:
    n = z.shape[-1]
    out[..., m, 0 : 2 * n : 2], out[..., m, 1 : 2 * n : 2] = z.real, z.imag


def _no_coefficients(field: np.ndarray, top: int) -> np.ndarray:
    return np.zeros((*field.shape[:-2], top + 1, 2 * (top + 1)))


def to_spectral(field: np.ndarray, lats: tuple[float, ...], top: int) -> np.ndarray:
    w = gaussian_nodes(lats)[1]
    p = legendre(lats, top)
    f = np.fft.fft(field, axis=-1) / field.shape[-1]
    out = _no_coefficients(field, top)
    for m in range(top + 1):
        put_order(out, m, f[..., m] @ (p[m, m : top + 1] * w).T)
    return out


def from_spectral(coefficients: np.ndarray, lats: tuple[float, ...], nlon: int) -> np.ndarray:
    top = coefficients.shape[-2] - 1
    p = legendre(lats, top)
    f = np.zeros((*coefficients.shape[:-2], len(lats), nlon), complex)
    for m in range(min(top, nlon // 2) + 1):
        f[..., m] = order(coefficients, m) @ p[m, m : top + 1]
        if m:
            f[..., nlon - m] = np.conj(f[..., m])
    return np.fft.ifft(f, axis=-1).real * nlon


def resized(c: np.ndarray, top: int) -> np.ndarray:
    out = _no_coefficients(c, top)
    old = c.shape[-2] - 1
    for m in range(min(top, old) + 1):
        n = 2 * (min(top, old) + 1 - m)
        out[..., m, :n] = c[..., m, :n]
    return out


def to_fourier(f: np.ndarray) -> np.ndarray:
    c = np.fft.rfft(f, axis=-1) / f.shape[-1]
    return np.stack([c.real, c.imag], axis=-1).reshape(*f.shape[:-1], -1)


def from_fourier(c: np.ndarray) -> np.ndarray:
    z = c[..., 0::2] + 1j * c[..., 1::2]
    return np.fft.irfft(z, 2 * (z.shape[-1] - 1), axis=-1) * 2 * (z.shape[-1] - 1)


def uv_to_dv(u: np.ndarray, v: np.ndarray, lats: tuple[float, ...], top: int) -> tuple[np.ndarray, np.ndarray]:
    """Spectral divergence and vorticity of wind on a Gaussian grid, by parts in latitude."""
    mu, w = gaussian_nodes(lats)
    cos2 = 1 - mu * mu
    p = legendre(lats, top)
    fu, fv = (np.fft.fft(a * np.sqrt(cos2)[:, None], axis=-1) / a.shape[-1] for a in (u, v))
    div, vor = _no_coefficients(u, top), _no_coefficients(u, top)
    for m in range(top + 1):
        a, b = (w / cos2 * p[m, m : top + 1]).T, (w / cos2 * slopes(p, m, top)).T
        put_order(div, m, (1j * m * (fu[..., m] @ a) - fv[..., m] @ b) / RADIUS)
        put_order(vor, m, (1j * m * (fv[..., m] @ a) + fu[..., m] @ b) / RADIUS)
    return div, vor


def dv_to_uv(div: np.ndarray, vor: np.ndarray, lats: tuple[float, ...], nlon: int) -> tuple[np.ndarray, np.ndarray]:
    """Wind on a Gaussian grid of spectral divergence and vorticity."""
    top = div.shape[-2] - 1
    mu = np.sin(np.radians(lats))
    cos = np.sqrt(1 - mu * mu)
    p = legendre(lats, top)
    fu, fv = (np.zeros((*div.shape[:-2], len(mu), nlon), complex) for _ in range(2))
    for m in range(min(top, nlon // 2) + 1):
        n = np.arange(m, top + 1)
        scale = np.where(n > 0, -RADIUS * RADIUS / np.maximum(n * (n + 1), 1), 0.0)
        chi, psi = order(div, m) * scale, order(vor, m) * scale
        h, q = slopes(p, m, top), p[m, m : top + 1]
        fu[..., m] = (1j * m * (chi @ q) - psi @ h) / RADIUS / cos
        fv[..., m] = (1j * m * (psi @ q) + chi @ h) / RADIUS / cos
        if m:
            fu[..., nlon - m], fv[..., nlon - m] = np.conj(fu[..., m]), np.conj(fv[..., m])
    return np.fft.ifft(fu, axis=-1).real * nlon, np.fft.ifft(fv, axis=-1).real * nlon
