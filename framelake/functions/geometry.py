"""Vectors, periodic cells and minimum images as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
CELL_TYPE = "struct<h:array<double>,g:array<double>,a:double,b:double,c:double,alpha:double,beta:double,gamma:double,volume:double>"


@dataclass(frozen=True)
class Cell:
    """A periodic cell. ``h`` holds the lattice vectors a, b, c one after the other."""

    h: tuple[float, ...]

    @staticmethod
    def of_lengths(a: float, b: float, c: float, alpha: float = 90.0, beta: float = 90.0, gamma: float = 90.0) -> Cell:
        """From lengths and angles in degrees: a along x, b in the plane of x and y."""
        ca, cb, cg = (0.0 if v == 90.0 else math.cos(math.radians(v)) for v in (alpha, beta, gamma))
        sg = math.sin(math.radians(gamma))
        cy = (ca - cb * cg) / sg
        return Cell((a, 0.0, 0.0, b * cg, b * sg, 0.0, c * cb, c * cy, c * math.sqrt(max(0.0, 1 - cb * cb - cy * cy))))

    @property
    def vectors(self) -> list[tuple[float, ...]]:
        return [self.h[i : i + 3] for i in (0, 3, 6)]

    @property
    def volume(self) -> float:
        a, b, c = self.vectors
        return abs(sum(x * y for x, y in zip(a, _cross(b, c), strict=True)))

    @property
    def g(self) -> tuple[float, ...]:
        """Reciprocal vectors (without 2 pi): ``g_i . r`` are fractional coordinates."""
        a, b, c = self.vectors
        v = sum(x * y for x, y in zip(a, _cross(b, c), strict=True))
        return tuple(x / v for u in (_cross(b, c), _cross(c, a), _cross(a, b)) for x in u)

    @property
    def parameters(self) -> tuple[float, ...]:
        """a, b, c and the angles in degrees."""
        a, b, c = self.vectors
        n = [math.sqrt(sum(x * x for x in v)) for v in (a, b, c)]
        angle = lambda u, v, p, q: math.degrees(math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(u, v, strict=True)) / (p * q)))))
        return (*n, angle(b, c, n[1], n[2]), angle(a, c, n[0], n[2]), angle(a, b, n[0], n[1]))

    def row(self) -> dict:
        """The cell as a value of ``CELL_TYPE``."""
        names = ("a", "b", "c", "alpha", "beta", "gamma")
        return {"h": list(self.h), "g": list(self.g), **dict(zip(names, self.parameters, strict=True)), "volume": self.volume}

    def column(self) -> Column:
        r = self.row()
        arrays = [F.array(*[F.lit(float(x)) for x in r[k]]).alias(k) for k in ("h", "g")]
        return F.struct(*arrays, *[F.lit(float(r[k])).alias(k) for k in ("a", "b", "c", "alpha", "beta", "gamma", "volume")])


def _cross(u, v):
    return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{k}{suffix}") for k in "xyz")


def sub(u: Vec, v: Vec) -> Vec:
    return tuple(a - b for a, b in zip(u, v, strict=True))


def dot(u: Vec, v: Vec) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: Vec, v: Vec) -> Vec:
    return _cross(u, v)


def norm(u: Vec) -> Column:
    return F.sqrt(dot(u, u))


def unit(u: Vec) -> Vec:
    n = norm(u)
    return tuple(a / n for a in u)


def _rows(cell: Column, name: str) -> list[Vec]:
    m = cell[name]
    return [tuple(m[3 * i + k] for k in range(3)) for i in range(3)]


def fractional(r: Vec, cell: Column) -> Vec:
    return tuple(dot(g, r) for g in _rows(cell, "g"))


def cartesian(f: Vec, cell: Column) -> Vec:
    a, b, c = _rows(cell, "h")
    return tuple(f[0] * a[k] + f[1] * b[k] + f[2] * c[k] for k in range(3))


def wrapped(r: Vec, cell: Column) -> Vec:
    """Into the cell by the floor of fractional coordinates; as it is without a cell."""
    f = fractional(r, cell)
    shift = cartesian(tuple(F.floor(x) for x in f), cell)
    return tuple(F.when(cell.isNull(), a).otherwise(a - s) for a, s in zip(r, shift, strict=True))


def nearest_image(d: Vec, cell: Column | None) -> Vec:
    """A difference vector reduced by whole cells, component by component; as it is without a cell.

    True nearest images need a cutoff of at most half the least perpendicular width.
    """
    if cell is None:
        return d
    f = fractional(d, cell)
    shift = cartesian(tuple(F.floor(x + 0.5) for x in f), cell)
    return tuple(F.when(cell.isNull(), a).otherwise(a - s) for a, s in zip(d, shift, strict=True))


def widths(cell: Column) -> Vec:
    """Perpendicular widths of the cell: one over the lengths of the reciprocal vectors."""
    return tuple(1.0 / norm(g) for g in _rows(cell, "g"))


def cell_from_parameters(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """``CELL_TYPE`` column from lengths and angles (degrees), in the orientation of ``Cell.of_lengths``."""
    ca, cb, cg = (F.cos(F.radians(v)) for v in (alpha, beta, gamma))
    sg = F.sin(F.radians(gamma))
    cy = (ca - cb * cg) / sg
    zero = F.lit(0.0)
    h = [(a, zero, zero), (b * cg, b * sg, zero), (c * cb, c * cy, c * F.sqrt(1 - cb * cb - cy * cy))]
    volume = dot(h[0], _cross(h[1], h[2]))
    g = [tuple(x / volume for x in _cross(h[i], h[j])) for i, j in ((1, 2), (2, 0), (0, 1))]
    flat = lambda m: F.array(*[x for v in m for x in v])
    made = F.struct(flat(h).alias("h"), flat(g).alias("g"), a.alias("a"), b.alias("b"), c.alias("c"), alpha.alias("alpha"), beta.alias("beta"), gamma.alias("gamma"), volume.alias("volume"))
    plausible = [v.between(1e-6, 1e6) for v in (a, b, c, alpha, beta, gamma)]
    ok = plausible[0]
    for p in plausible[1:]:
        ok = ok & p
    return F.when(ok, made)


def angle_between(u: Vec, v: Vec) -> Column:
    """Angle in radians, with the cosine held to [-1, 1]."""
    cosine = dot(u, v) / (norm(u) * norm(v))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def dihedral_angle(b1: Vec, b2: Vec, b3: Vec) -> Column:
    """Signed dihedral in radians of three successive bond vectors."""
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.atan2(dot(unit(b2), cross(n1, n2)), dot(n1, n2))


def plane_distance(ij: Vec, ik: Vec, il: Vec) -> Column:
    """Distance of the common start from the plane through the three ends."""
    n = cross(sub(ik, ij), sub(il, ij))
    return F.abs(dot(ij, n)) / norm(n)
