"""Links between the cells of two regular grids, and their weights."""

from __future__ import annotations

import math

import numpy as np

from isohyet.grid import Grid

Links = tuple[np.ndarray, np.ndarray, np.ndarray]  # source cell, target cell, weight


def _points(g: Grid) -> np.ndarray:
    lon, lat = np.meshgrid(np.radians(g.lons), np.radians(g.lats))
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1).reshape(-1, 3)


def nearest(src: Grid, dst: Grid, n: int) -> Links:
    """The n nearest centres, weighted by one over the distance; ties go to the lower cell."""
    a, b = _points(src), _points(dst)
    n = min(n, len(a))
    rows = []
    for lo in range(0, len(b), 512):
        gap = np.arccos(np.clip(b[lo : lo + 512] @ a.T, -1, 1)).round(12)
        order = np.argsort(gap, axis=1, kind="stable")[:, :n]
        w = 1 / np.maximum(np.take_along_axis(gap, order, 1), 1e-20)
        rows.append((order, w / w.sum(axis=1, keepdims=True)))
    cells, weights = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    return cells.ravel(), np.repeat(np.arange(len(b)), n), weights.ravel()


def _between(values: tuple[float, ...], at: float, around: bool) -> tuple[int, int, float] | None:
    """Positions on both sides of a value, and the share of the second."""
    v = np.array(values)
    if around:
        at = v[0] + (at - v[0]) % 360
    if len(v) == 1:
        return (0, 0, 0.0) if abs(at - v[0]) < 1e-9 else None
    down = v[0] > v[-1]
    k = int(np.searchsorted(-v if down else v, -at if down else at, "right")) - 1
    if around and k == len(v) - 1:
        gap = v[0] + 360 - v[-1]
        return k, 0, (at - v[-1]) / gap if gap else 0.0
    if k == len(v) - 1 and abs(at - v[-1]) < 1e-9:
        return k, k, 0.0
    if k < 0 or k >= len(v) - 1:
        return None
    return k, k + 1, (at - v[k]) / (v[k + 1] - v[k])


def bilinear(src: Grid, dst: Grid) -> Links:
    """Four corners around a target; targets outside the source have no links."""
    s, t, w = [], [], []
    xs = [_between(src.lons, lon, src.circular) for lon in dst.lons]
    ys = [_between(src.lats, lat, False) for lat in dst.lats]
    for j, y in enumerate(ys):
        for i, x in enumerate(xs):
            if x is None or y is None:
                continue
            for a, p in ((x[0], 1 - x[2]), (x[1], x[2])):
                for b, q in ((y[0], 1 - y[2]), (y[1], y[2])):
                    if p * q:
                        s.append(b * src.nx + a), t.append(j * dst.nx + i), w.append(p * q)
    return np.array(s, int), np.array(t, int), np.array(w, float)


def _overlap(a: list[float], b: list[float], around: bool) -> list[list[tuple[int, float]]]:
    """For each cell of b, the cells of a that it overlaps, and by how much."""
    out = []
    lo_a, hi_a = np.minimum(a[:-1], a[1:]), np.maximum(a[:-1], a[1:])
    for p, q in zip(b, b[1:]):
        low, high = min(p, q), max(p, q)
        found = np.zeros(len(lo_a))
        for turn in (-720, -360, 0, 360, 720) if around else (0,):
            found += np.maximum(0, np.minimum(hi_a + turn, high) - np.maximum(lo_a + turn, low))
        out.append([(int(k), float(found[k])) for k in np.flatnonzero(found > 1e-12)])
    return out


def conservative(src: Grid, dst: Grid, normalise: str = "frac") -> Links:
    """Overlap areas of regular cells, over the covered part of the target (frac) or all of it (dest)."""
    sines = lambda g: [math.sin(math.radians(e)) for e in g.lat_edges()]
    xs, ys = _overlap(src.lon_edges(), dst.lon_edges(), True), _overlap(sines(src), sines(dst), False)
    ex, ey = dst.lon_edges(), sines(dst)
    s, t, w = [], [], []
    for j, rows in enumerate(ys):
        for i, columns in enumerate(xs):
            links = [(b * src.nx + a, p * q) for b, q in rows for a, p in columns]
            whole = abs(ex[i + 1] - ex[i]) * abs(ey[j + 1] - ey[j])
            total = sum(v for _, v in links) if normalise == "frac" else whole
            for cell, v in links:
                s.append(cell), t.append(j * dst.nx + i), w.append(v / total)
    return np.array(s, int), np.array(t, int), np.array(w, float)


def _slopes(n: int, around: bool) -> list[list[tuple[int, float]]]:
    """Central differences in index space as (position, factor); one-sided at open ends."""
    out = []
    for k in range(n):
        a, b = ((k - 1) % n, (k + 1) % n) if around else (max(0, k - 1), min(n - 1, k + 1))
        gap = 2 if around or 0 < k < n - 1 else 1
        out.append([(b, 1 / gap), (a, -1 / gap)] if n > 1 else [])
    return out


def bicubic(src: Grid, dst: Grid) -> Links:
    """Hermite cubic through values, slopes and cross slopes of four corners, as weights of source cells."""
    acc: dict[tuple[int, int], float] = {}
    sx, sy = _slopes(src.nx, src.circular), _slopes(src.ny, False)
    h = lambda f: ((1 - f) ** 2 * (1 + 2 * f), f * f * (3 - 2 * f), f * (1 - f) ** 2, f * f * (f - 1))  # noqa: E731  values at both ends, slopes at both ends
    for j, lat in enumerate(dst.lats):
        y = _between(src.lats, lat, False)
        for i, lon in enumerate(dst.lons):
            x = _between(src.lons, lon, src.circular)
            if x is None or y is None:
                continue
            px: dict[int, float] = {}
            py: dict[int, float] = {}
            for (a, b, f), own, slopes in ((x, px, sx), (y, py, sy)):
                v0, v1, s0, s1 = h(f)
                for k, v in ((a, v0), (b, v1)):
                    own[k] = own.get(k, 0) + v
                for k, s in ((a, s0), (b, s1)):
                    for at, c in slopes[k]:
                        own[at] = own.get(at, 0) + s * c
            for b, q in py.items():
                for a, p in px.items():
                    key = (b * src.nx + a, j * dst.nx + i)
                    acc[key] = acc.get(key, 0) + p * q
    s, t = (np.array([k[n] for k in acc], int) for n in (0, 1))
    return s, t, np.array(list(acc.values()), float)


def second_order(src: Grid, dst: Grid) -> Links:
    """Conservative weights with the source's slopes between the overlap's centre and the cell's."""
    acc: dict[tuple[int, int], float] = {}
    ex, ey, tx, ty = src.lon_edges(), src.lat_edges(), dst.lon_edges(), dst.lat_edges()
    sx, sy = _slopes(src.nx, src.circular), _slopes(src.ny, False)
    sine = lambda e: [math.sin(math.radians(v)) for v in e]
    xs, ys = _overlap(ex, tx, True), _overlap(sine(ey), sine(ty), False)

    def centre(edges: list[float], k: int, low: float, high: float, around: bool) -> float:
        """Centre of an overlap, in cells from the source cell's centre."""
        a, b = edges[k], edges[k + 1]
        lo, hi = min(a, b), max(a, b)
        mids, total = 0.0, 0.0
        for turn in (-720, -360, 0, 360, 720) if around else (0,):
            p, q = max(lo + turn, min(low, high)), min(hi + turn, max(low, high))
            if q > p:
                mids += (q - p) * ((p + q) / 2 - turn)
                total += q - p
        return ((mids / total - (a + b) / 2) / (b - a)) if total else 0.0

    for j, rows in enumerate(ys):
        for i, columns in enumerate(xs):
            total = sum(q * p for _, q in rows for _, p in columns)
            for b, q in rows:
                oy = centre(ey, b, ty[j], ty[j + 1], False)
                for a, p in columns:
                    w, ox = p * q / total, centre(ex, a, tx[i], tx[i + 1], True)
                    target = j * dst.nx + i
                    for cell, c in [(b * src.nx + a, 1.0)] + [(b * src.nx + k, ox * f) for k, f in sx[a]] + [(k * src.nx + a, oy * f) for k, f in sy[b]]:
                        acc[cell, target] = acc.get((cell, target), 0.0) + w * c
    s, t = (np.array([k[n] for k in acc], int) for n in (0, 1))
    return s, t, np.array(list(acc.values()), float)


def largest(src: Grid, dst: Grid) -> Links:
    """The one source cell of the largest overlap."""
    s, t, w = conservative(src, dst)
    order = np.lexsort((s, -w, t))
    first = order[np.append(True, np.diff(t[order]) > 0)] if len(order) else order
    return s[first], t[first], np.ones(len(first))


METHODS = {
    "nn": lambda a, b: nearest(a, b, 1),
    "dis": lambda a, b: nearest(a, b, 4),
    "bil": bilinear,
    "bic": bicubic,
    "con": conservative,
    "ycon": conservative,
    "con2": second_order,
    "laf": largest,
}
