"""Regular horizontal grids: coordinates, areas and weights as column expressions, without a join."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371000.0


def _corners(centres: tuple[float, ...]) -> list[float]:
    """Cell edges halfway between centres, and as far beyond the outer ones."""
    if len(centres) == 1:
        return [centres[0] - 180.0, centres[0] + 180.0]
    mid = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    return [2 * centres[0] - mid[0], *mid, 2 * centres[-1] - mid[-1]]


def _unit(lon: float, lat: float) -> np.ndarray:
    a, b = math.radians(lon), math.radians(lat)
    return np.array([math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)])


def _arc(p: np.ndarray, q: np.ndarray) -> float:
    return math.atan2(float(np.linalg.norm(np.cross(p, q))), float(p @ q))


def triangle(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> float:
    """Area of a great-circle triangle on the unit sphere, by l'Huilier's formula."""
    a, b, c = _arc(q, r), _arc(p, r), _arc(p, q)
    s = (a + b + c) / 2
    t = math.tan(s / 2) * math.tan((s - a) / 2) * math.tan((s - b) / 2) * math.tan((s - c) / 2)
    return 4 * math.atan(math.sqrt(max(0.0, t)))


@dataclass(frozen=True)
class Grid:
    """lons and lats are cell centres in degrees; x and y are positions in them."""

    lons: tuple[float, ...]
    lats: tuple[float, ...]
    kind: str = "lonlat"
    mask: tuple[int, ...] | None = None
    areas: tuple[float, ...] | None = None
    attrs: dict = field(default_factory=dict, compare=False)

    @property
    def nx(self) -> int:
        return len(self.lons)

    @property
    def ny(self) -> int:
        return len(self.lats)

    @property
    def size(self) -> int:
        return self.nx * self.ny

    @property
    def circular(self) -> bool:
        return self.nx > 1 and abs(abs(self.lons[1] - self.lons[0]) * self.nx - 360) < 1e-6

    def lon_edges(self) -> list[float]:
        return _corners(self.lons)

    def lat_edges(self) -> list[float]:
        """Edges of the rows; the outer ones are at the pole if they come within two degrees of it."""
        edges = _corners(self.lats) if self.ny > 1 else [-90.0, 90.0]
        return [math.copysign(90.0, e) if abs(e) > 88 and k in (0, len(edges) - 1) else e for k, e in enumerate(edges)]

    def area(self, x: int, y: int, radius: float = EARTH_RADIUS) -> float:
        """Area between the cell's corners along great circles."""
        a, b = self.lon_edges()[x : x + 2]
        south, north = self.lat_edges()[y : y + 2]
        p, q, r, s = _unit(a, south), _unit(b, south), _unit(b, north), _unit(a, north)
        return (triangle(p, q, r) + triangle(p, r, s)) * radius * radius

    def row_areas(self, radius: float = EARTH_RADIUS) -> list[float]:
        """The area of a cell of each row; columns of a regular grid are equally wide."""
        return [self.area(0, y, radius) for y in range(self.ny)]

    def row_weights(self) -> list[float]:
        own = self.row_areas(1.0)
        total = sum(own) * self.nx
        return [a / total for a in own]

    @staticmethod
    def _pick(values: tuple[float, ...] | list[float], at: Column) -> Column:
        step = (values[-1] - values[0]) / (len(values) - 1) if len(values) > 1 else 0.0
        if all(abs(values[0] + step * i - v) < 1e-12 for i, v in enumerate(values)):
            return F.lit(float(values[0])) + at * F.lit(step)
        return F.element_at(F.lit([float(v) for v in values]), (at + 1).cast("int"))

    def lon(self, x: Column | None = None) -> Column:
        return self._pick(self.lons, F.col("x") if x is None else x)

    def lat(self, y: Column | None = None) -> Column:
        return self._pick(self.lats, F.col("y") if y is None else y)

    def weight(self) -> Column:
        """Relative cell area; set areas win over those of the coordinates."""
        if self.areas is not None:
            return F.element_at(F.lit(list(self.areas)), (F.col("y") * self.nx + F.col("x") + 1).cast("int"))
        return F.element_at(F.lit(self.row_weights()), (F.col("y") + 1).cast("int"))

    def with_(self, **changes: object) -> Grid:
        return replace(self, **changes)


def gaussian_latitudes(n: int) -> tuple[float, ...]:
    """2n latitudes, north to south."""
    return tuple(float(v) for v in -np.degrees(np.arcsin(np.polynomial.legendre.leggauss(2 * n)[0])))


#: Boxes of the named regional grids: lon1, lon2, lat1, lat2 (fixed values).
REGIONS = {
    "global": (-180, 180, -90, 90),
    "africa": (-20, 60, -40, 40),
    "europe": (-30, 60, 30, 80),
    "germany": (5.6, 15.2, 47.1, 55.1),
}


def named(text: str) -> Grid:
    """r36x18, lon=10_lat=50, n16, t21grid, global_10, europe_2 and the like."""
    text = text.strip()
    if m := re.fullmatch(r"r(\d+)x(\d+)", text):
        nx, ny = int(m[1]), int(m[2])
        return Grid(tuple(360 / nx * i for i in range(nx)), tuple(-90 + 180 / ny * (j + 0.5) for j in range(ny)))
    if m := re.fullmatch(r"lon=([-+.\d]+)[_/]lat=([-+.\d]+)", text):
        return Grid((float(m[1]),), (float(m[2]),))
    if m := re.fullmatch(r"n(\d+)|t(\d+)grid", text):
        n = int(m[1]) if m[1] else (3 * int(m[2]) + 1 + 3) // 4
        return Grid(tuple(360 / (4 * n) * i for i in range(4 * n)), gaussian_latitudes(n), "gaussian")
    if (m := re.fullmatch(r"([a-z]+)_([.\d]+)", text)) and m[1] in REGIONS:
        step, (a, b, c, d) = float(m[2]), REGIONS[m[1]]
        return Grid(tuple(a + step * (i + 0.5) for i in range(int((b - a) / step))), tuple(c + step * (j + 0.5) for j in range(int((d - c) / step))))
    raise ValueError(f"no grid is named {text}")
