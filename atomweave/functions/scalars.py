"""Scalar functions on columns. Vectors are triples of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
PI = math.pi


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def hermite(x: Column, degree: int, a: float = 1.0) -> Column:
    """The polynomial of the derivative of a Gaussian, degree 0 to 5, scaled by a in the way the grids need."""
    u = F.lit(a) * x
    return {0: lambda: F.lit(1.0), 1: lambda: -2.0 * u, 2: lambda: 4.0 * u * u - 2.0 * a, 3: lambda: -8.0 * u * u * u + 12.0 * u, 4: lambda: 16.0 * u * u * u * u - 48.0 * u * u + 12.0 * a * a, 5: lambda: -32.0 * u * u * u * u * u + 160.0 * u * u * u - 120.0 * u}[degree]()


def chebyshev(x: Column, degree: int) -> Column:
    """T_1 to T_5 by the three-term recurrence."""
    before, now = F.lit(1.0), x
    for _ in range(degree - 1):
        before, now = now, 2.0 * x * now - before
    return now


def cutoff(r: Column, rcut: float) -> Column:
    return 0.5 * (F.cos(PI * r / rcut) + 1.0)


def cutoff_slope(r: Column, rcut: float) -> Column:
    return -PI * F.sin(PI * r / rcut) / (2.0 * rcut)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def cosine(a: Vec, b: Vec) -> Column:
    return clamp(dot(a, b) / (norm(a) * norm(b)))


def angle(a: Vec, b: Vec) -> Column:
    return F.acos(cosine(a, b))


def mean_charge(*z: Column) -> Column:
    """The geometric mean of charges."""
    product = z[0].cast("double")
    for x in z[1:]:
        product = product * x
    return {1: lambda p: p, 2: F.sqrt, 3: lambda p: F.pow(p, F.lit(1.0 / 3.0))}.get(len(z), lambda p: F.pow(p, F.lit(1.0 / len(z))))(product)


def damping(power: float, *r: Column) -> Column:
    product = r[0]
    for x in r[1:]:
        product = product * x
    return F.pow(product, F.lit(float(power)))


def exponential_damping(power: float, *r: Column) -> Column:
    total = r[0]
    for x in r[1:]:
        total = total + x
    return F.exp(F.lit(float(power)) * total)


def unit(a: Vec) -> Vec:
    n = norm(a)
    return a[0] / n, a[1] / n, a[2] / n


def solid_angle(a: Vec, b: Vec, c: Vec) -> Column:
    u, v, w = unit(a), unit(b), unit(c)
    return 2.0 * F.atan2(F.abs(dot(u, cross(v, w))), F.greatest(1.0 + dot(u, v) + dot(u, w) + dot(v, w), F.lit(1e-10)))


def out_of_plane(a: Vec, b: Vec, c: Vec, m: Vec) -> Column:
    """Angle of m to the normal of the plane through a, b and c; 0 if either has no direction."""
    n = cross(minus(b, a), minus(c, a))
    size = norm(m) * norm(n)
    return F.when(size < 1e-10, F.lit(0.0)).otherwise(F.acos(F.least(F.lit(1.0), F.abs(dot(m, n)) / size)))


def dihedral(a: Vec, b: Vec, c: Vec) -> Column:
    """Signed angle between the planes of consecutive bonds a, b and b, c."""
    n1, n2 = cross(a, b), cross(b, c)
    return F.atan2(norm(b) * dot(a, n2), dot(n1, n2))


def cell_heights(cell: list[Vec], rcut: float) -> list[Column]:
    """Perpendicular heights of a cell; rcut + 1 where the cell is flat."""
    volume = F.abs(dot(cell[0], cross(cell[1], cell[2])))
    out = []
    for k in range(3):
        area = norm(cross(cell[(k + 1) % 3], cell[(k + 2) % 3]))
        out.append(F.when(area > 1e-10, volume / area).otherwise(F.lit(rcut + 1.0)))
    return out


def image_shift(n: Vec, cell: list[Vec]) -> Vec:
    return tuple(n[0] * cell[0][k] + n[1] * cell[1][k] + n[2] * cell[2][k] for k in range(3))


def next_fast_len(n: int) -> int:
    """The least number of at least n whose prime factors are 2, 3, 5, 7 or 11."""
    while True:
        rest = n
        for p in (2, 3, 5, 7, 11):
            while rest % p == 0 and rest > 1:
                rest //= p
        if rest == 1:
            return n
        n += 1


def gaussian_fold(values: list[Column], a: float) -> Column:
    """Product of Gaussians of width a at the values: struct (mu, sigma, zeta)."""

    def merge(s: Column, r: Column) -> Column:
        total = s["sigma"] + a
        gap = s["mu"] - r
        return F.struct(((s["mu"] * a + r * s["sigma"]) / total).alias("mu"), (s["sigma"] * a / total).alias("sigma"), (s["zeta"] * F.exp(-(gap * gap) / total)).alias("zeta"))

    first = F.struct(values[0].alias("mu"), F.lit(float(a)).alias("sigma"), F.lit(1.0).alias("zeta"))
    return F.aggregate(F.array(*values[1:]), first, merge)


def vdw_basis(r: Column, width: Column, a: float) -> Column:
    return F.exp(-a * r * r / (width * width))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def laplacian(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * l1(a, b))


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-gamma * F.pow(l2(a, b), F.lit(2.0)))


def polynomial(a: Column, b: Column, degree: int, gamma: float) -> Column:
    return F.pow(gamma * inner(a, b) + 1.0, F.lit(float(degree)))


def efficiency(mae: Column, dims: Column) -> Column:
    return mae * dims


def per_million(mae: Column, parameters: Column) -> Column:
    return mae / (parameters / 1e6)
