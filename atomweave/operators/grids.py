"""Convolution grids: Gaussians times Hermite polynomials, convolved with weighting functions and sampled on a uniform grid.

A grid has a fixed size (points x channels), whatever the data; it is built once by numpy on the driver, or by a
join of two index ranges in coarse form, and is broadcast. Channel = order * number of weights + weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Van der Waals radii by atomic number in Angstrom; elements that aren't listed have 1.
VDW = {
    1: 1.20, 2: 1.40, 3: 1.82, 4: 1.53, 5: 1.92, 6: 1.70, 7: 1.55, 8: 1.52, 9: 1.47, 10: 1.54,
    11: 2.27, 12: 1.73, 13: 1.84, 14: 2.10, 15: 1.80, 16: 1.80, 17: 1.75, 18: 1.88, 19: 2.75, 20: 2.31,
    28: 1.63, 29: 1.40, 30: 1.39,
    31: 1.87, 32: 2.11, 33: 1.85, 34: 1.90, 35: 1.85, 36: 2.02, 37: 3.03, 38: 2.49,
    46: 1.63, 47: 1.72, 48: 1.58, 49: 1.93, 50: 2.17,
    51: 2.06, 52: 2.06, 53: 1.98, 54: 2.16, 55: 3.43, 56: 2.49,
    78: 1.75, 79: 1.66, 80: 1.55, 81: 1.96, 82: 2.02, 83: 2.07, 84: 1.97, 85: 2.02, 86: 2.20,
    87: 3.48, 88: 2.83,
    92: 1.86,
}
GAMMA = 2.2508


@dataclass(frozen=True)
class Weight:
    """exp(-a r), 1 / (GAMMA (r + 1)^a), or cos(a v)."""

    kind: str
    a: float

    def values(self, x: np.ndarray) -> np.ndarray:
        return {"exp": lambda: np.exp(-self.a * x), "power": lambda: 1.0 / (GAMMA * (x + 1.0) ** self.a), "cos": lambda: np.cos(self.a * x)}[self.kind]()

    def column(self, x: Column) -> Column:
        return {"exp": lambda: F.exp(-self.a * x), "power": lambda: 1.0 / (GAMMA * F.pow(x + 1.0, F.lit(self.a))), "cos": lambda: F.cos(self.a * x)}[self.kind]()


@dataclass(frozen=True)
class Grid:
    """domain: length of the variable's range; width: exponent of the Gaussian; scale: what Hermite polynomials are scaled by; lag: cells by which
    the centred convolution trails (1 where the kernel has an even number of points); sign: factor of all orders above 0."""

    domain: float
    points: int
    weights: tuple[Weight, ...]
    orders: int
    width: float
    scale: float
    lag: int = 1
    sign: float = 1.0

    @property
    def step(self) -> float:
        return self.domain / self.points

    @property
    def channels(self) -> int:
        return self.orders * len(self.weights)


def _poly(x: np.ndarray, degree: int, a: float) -> np.ndarray:
    u = a * x
    return [np.ones_like(x), -2 * u, 4 * u**2 - 2 * a, -8 * u**3 + 12 * u, 16 * u**4 - 48 * u**2 + 12 * a * a, -32 * u**5 + 160 * u**3 - 120 * u][degree]


def _points(domain: float, step: float) -> int:
    return S.next_fast_len(int(domain / step))


def radial(rcut: float = 6.0, step: float = 0.0008, alphas=(1.5, 5.0), powers=(3.0, 5.0), order: int = 4, a: float = 2.0) -> Grid:
    weights = (*[Weight("exp", x) for x in alphas], *[Weight("power", x) for x in powers])
    return Grid(rcut, _points(rcut, step), weights, order + 1, a, math.sqrt(a), 1, (-math.sqrt(a)) ** (order + 1))


#: Distinct radii; elements of one radius share a grid, and a radius's place here is its class.
RADII = sorted({1.0, *VDW.values()})


def radius_class(z: Column) -> Column:
    """The class of an element's radius."""
    known = F.create_map(*[F.lit(x) for z_, r in VDW.items() for x in (z_, RADII.index(r))])
    return F.coalesce(known[z], F.lit(RADII.index(1.0)))


def radial_of(radius: float, rcut: float = 6.0, step: float = 0.0008, alphas=(1.5, 5.0), powers=(3.0, 5.0), order: int = 4) -> Grid:
    """The radial grid of a radius: its square is the width, and Hermite polynomials are scaled by it."""
    a = radius**2
    weights = (*[Weight("exp", x) for x in alphas], *[Weight("power", x) for x in powers])
    return Grid(rcut, _points(rcut, step), weights, order + 1, a, a)


def angular(step: float = 0.0002, n: int = 4, order: int = 4, a: float = 2.0) -> Grid:
    return Grid(math.pi, _points(math.pi, step), tuple(Weight("cos", float(k)) for k in range(1, n + 1)), order + 1, a, math.sqrt(a), 1, (-math.sqrt(a)) ** (order + 1))


def solid(step: float = 0.001, n: int = 4, order: int = 4, a: float = 1.0) -> Grid:
    return Grid(2 * math.pi, _points(2 * math.pi, step), tuple(Weight("cos", float(k)) for k in range(1, n + 1)), order + 1, a, math.sqrt(a), 0, (-math.sqrt(a)) ** (order + 1))


def out_of_plane(step: float = 0.001, n: int = 3, order: int = 3, a: float = 1.0) -> Grid:
    return Grid(math.pi, _points(math.pi, step), tuple(Weight("cos", float(k)) for k in range(1, n + 1)), order + 1, a, math.sqrt(a), 0, (-math.sqrt(a)) ** (order + 1))


def legacy(rcut: float = 10.0, step: float = 0.0008, order: int = 4) -> Grid:
    """The grid of the Gaussian-product four-body term."""
    weights = (*[Weight("exp", 1.5 * (k + 1)) for k in range(3)], *[Weight("power", float(k + 2)) for k in range(2)])
    return Grid(rcut, _points(rcut, step), weights, order + 1, 6.0, 6.0)


def sample(g: Grid) -> np.ndarray:
    """(channels, points) by fast Fourier transforms."""
    n, step = g.points, g.step
    x = np.arange(n) * step
    k = np.arange(-n, n) * step
    gauss = np.exp(-g.width * k * k)
    size = 1 << (3 * n).bit_length()
    out = []
    for m in range(g.orders):
        f = np.fft.rfft(gauss * _poly(k, m, g.scale) * (g.sign if m else 1.0), size)
        for w in g.weights:
            full = np.fft.irfft(np.fft.rfft(w.values(x), size) * f, size)
            v = full[n - g.lag : 2 * n - g.lag]
            out.append(v / np.abs(v).max())
    return np.array(out)


#: The most numbers a table that is broadcast may have.
MOST_CELLS = 1 << 25


def _rows(spark: SparkSession, columns: dict[str, np.ndarray], g: np.ndarray) -> DataFrame:
    """Columns beside g (rows x channels), as one Arrow table."""
    if g.size > MOST_CELLS:
        raise ValueError(f"a grid table of {g.size} numbers; use a larger step or fewer channels")
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, g.size + 1, g.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(g).ravel()))
    return spark.createDataFrame(pa.table({**{n: pa.array(c, pa.int32()) for n, c in columns.items()}, "g": vectors}))


def table(spark: SparkSession, g: Grid, values: np.ndarray | None = None) -> DataFrame:
    """(idx, g): the channels at each grid point."""
    v = (sample(g) if values is None else values).T
    return _rows(spark, {"idx": np.arange(len(v))}, v)


def element_table(spark: SparkSession, make=radial_of) -> DataFrame:
    """(cls, idx, g) of the grid make(radius) of every radius class."""
    values = [sample(make(r)).T for r in RADII]
    n = len(values[0])
    return _rows(spark, {"cls": np.repeat(np.arange(len(RADII)), n), "idx": np.tile(np.arange(n), len(RADII))}, np.vstack(values))


def slope_table(spark: SparkSession, g: Grid) -> DataFrame:
    """(idx, g, slope): the channels at each grid point and their change to the next, by the step; what a linear lookup has within the cell."""
    v = sample(g).T
    both = np.hstack([v, (np.vstack([v[1:], v[-1:]]) - v) / g.step])
    rows = _rows(spark, {"idx": np.arange(len(v))}, both)
    return rows.select("idx", F.slice("g", 1, g.channels).alias("g"), F.slice("g", g.channels + 1, g.channels).alias("slope"))


def coarse(spark: SparkSession, g: Grid) -> DataFrame:
    """(channel, idx, value) by direct summation in Spark; for grids of up to some hundred points."""
    n, step = g.points, g.step
    at = spark.range(n).select(F.col("id").cast("int").alias("idx"))
    k = spark.range(n).select(F.col("id").cast("int").alias("k"))
    both = at.join(k, F.lit(True))
    x = (F.col("idx") - F.col("k") - g.lag) * F.lit(step)
    gauss = F.exp(-g.width * x * x)
    sums = []
    for m in range(g.orders):
        f = gauss * S.hermite(x, m, g.scale) * (g.sign if m else 1.0)
        sums += [F.sum(w.column(F.col("k") * F.lit(step)) * f).alias(f"c{m * len(g.weights) + i}") for i, w in enumerate(g.weights)]
    wide = both.groupBy("idx").agg(*sums)
    long = wide.select("idx", F.posexplode(F.array(*[F.col(f"c{c}") for c in range(g.channels)])).alias("channel", "raw"))
    return long.select("channel", "idx", (F.col("raw") / F.max(F.abs("raw")).over(Window.partitionBy("channel"))).alias("value"))


def gradient(values: DataFrame, step: float) -> DataFrame:
    """(channel, idx, value) -> with slope: central differences, one-sided at the ends."""
    w = Window.partitionBy("channel").orderBy("idx")
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    slope = F.when(before.isNull(), (after - F.col("value")) / step).when(after.isNull(), (F.col("value") - before) / step).otherwise((after - before) / (2.0 * step))
    return values.withColumn("slope", slope)


def cell_of(v: Column, g: Grid, how: str = "floor") -> Column:
    """The grid point of a value; a billionth of a cell is added so values on a cell's edge fall alike on any machine."""
    c = v / g.step
    i = F.rint(c) if how == "round" else F.floor(c + 1e-9)
    return F.least(F.greatest(i.cast("int"), F.lit(0)), F.lit(g.points - 1))


def fraction_of(v: Column, g: Grid) -> Column:
    """How far a value is into its cell, 0 to 1, for linear lookups."""
    return F.least(F.greatest(v / g.step - cell_of(v, g), F.lit(0.0)), F.lit(1.0))
