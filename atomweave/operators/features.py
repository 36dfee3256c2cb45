"""Many-body features of atoms.

A feature is linear in the histogram of grid cells, so tuples are first summed by (structure, centre, cell), which needs no
grid, and only these few rows are joined with the broadcast grid and summed over its channels as columns of one
aggregate: tuples are never multiplied by channels, and all steps share the partitioning by structure.
Results are (structure_id, i, z_i, features array); centres without tuples have no row, zero features after with_all_atoms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import scalars as S
from . import grids as G
from .pooling import arrays
from .tuples import neighbor_arrays, vec

KEY = ["structure_id", "i"]


def from_cells(cells: DataFrame, grid: DataFrame, channels: list[tuple[int, str]], on: list[str], keys: list[str] = KEY) -> DataFrame:
    """cells(keys, on..., weights) -> (keys, features): feature n sums weight channels[n][1] times grid channel channels[n][0]."""
    joined = cells.join(F.broadcast(grid), on)
    sums = [F.expr(f"sum({w} * get(g, {c})) AS f{k}") for k, (c, w) in enumerate(channels)]
    return joined.groupBy(*keys).agg(*sums).select(*keys, F.array(*[f"f{k}" for k in range(len(channels))]).alias("features"))


def _histogram(t: DataFrame, value: Column, g: G.Grid, weights: dict[str, Column], lookup: str, *also: str) -> DataFrame:
    """Sums of the weights by centre and cell; a linear lookup divides a weight between a cell and the next."""
    if lookup == "linear":
        f = G.fraction_of(value, g)
        at = G.cell_of(value, g)
        both = F.array(F.struct(at.alias("idx"), (1.0 - f).alias("f")), F.struct(F.least(at + 1, F.lit(g.points - 1)).alias("idx"), f.alias("f")))
        rows = t.select(*KEY, *also, F.explode(both).alias("c"), *[c.alias(n) for n, c in weights.items()]).select(*KEY, *also, "c.idx", *[(F.col(n) * F.col("c.f")).alias(n) for n in weights])
    else:
        rows = t.select(*KEY, *also, G.cell_of(value, g, lookup).alias("idx"), *[c.alias(n) for n, c in weights.items()])
    return rows.groupBy(*KEY, *also, "idx").agg(*[F.sum(n).alias(n) for n in weights])


def two_body(pairs: DataFrame, grid: DataFrame, g: G.Grid, rcut: float | None, lookup: str = "floor", by_element: bool = False) -> DataFrame:
    """Sum over neighbours of sqrt(z_i z_j), the cutoff (none if rcut is None) and the grid at the distance; by_element takes the grid of the
    radius class of the neighbour's element, from a table (cls, idx, g)."""
    w = S.mean_charge(F.col("z_i"), F.col("z_j"))
    w = w if rcut is None else w * S.cutoff(F.col("r"), rcut)
    also = ["cls"] if by_element else []
    pairs = pairs.withColumn("cls", G.radius_class(F.col("z_j"))) if by_element else pairs
    cells = _histogram(pairs, F.col("r"), g, {"w": w}, lookup, *also)
    return from_cells(cells, grid, [(c, "w") for c in range(g.channels)], [*also, "idx"])


def _three_body(t: DataFrame, names: dict[str, str], g: G.Grid, grid: DataFrame, rcut: float | None, power: float, factor: float, lookup: str, closed: bool) -> DataFrame:
    r = [F.col(names[k]) for k in ("r1", "r2", "r3")]
    w = factor * S.mean_charge(F.col("z_i"), F.col(names["z1"]), F.col(names["z2"])) / S.damping(power, *r)
    if rcut is not None:
        third = S.cutoff(r[2], rcut)
        w = w * S.cutoff(r[0], rcut) * S.cutoff(r[1], rcut) * (F.when(r[2] < rcut, third).otherwise(0.0) if closed else third)
    cells = _histogram(t, F.acos(F.col(names["c1"])), g, {"w": w, "wc": w * F.col(names["c2"]) * F.col(names["c3"])}, lookup)
    n = len(g.weights)
    return from_cells(cells, grid, [(c, "wc" if c % n == 0 else "w") for c in range(g.channels)], ["idx"])


def three_body(triples: DataFrame, grid: DataFrame, g: G.Grid, rcut: float, power: float = 2.0, lookup: str = "floor") -> DataFrame:
    """Periodic: twice the sum over neighbour pairs; the first weight also has the cosines at the other two atoms; a pair farther apart than rcut adds nothing."""
    names = {"r1": "r_p", "r2": "r_q", "r3": "r_pq", "z1": "z_p", "z2": "z_q", "c1": "cos1", "c2": "cos2", "c3": "cos3"}
    return _three_body(triples, names, g, grid, rcut, power, 2.0, lookup, True)


def molecular_three_body(triples: DataFrame, grid: DataFrame, g: G.Grid, rcut: float | None = None, power: float = 2.0, lookup: str = "floor") -> DataFrame:
    """Molecular: as three_body per centre of a triple, counted in both orders; no cutoff unless rcut is given, and then the third distance isn't cut off."""
    names = {"r1": "r_ij", "r2": "r_ik", "r3": "r_jk", "z1": "z_j", "z2": "z_k", "c1": "cos_i", "c2": "cos_j", "c3": "cos_k"}
    return _three_body(triples, names, g, grid, rcut, power, 2.0, lookup, False)


def _kinds(kinds: list[tuple], steps: list[float], points: list[int]) -> Column:
    """What a histogram depends on, as an array of structs: kind (its place), rcut, power, step, points, round."""
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(float(x[0])).alias("rcut"), F.lit(float(x[3] if len(x) > 3 else 0)).alias("power"), F.lit(float(step)).alias("step"), F.lit(n).alias("points"), F.lit(x[2] == "round").alias("round")) for k, (x, step, n) in enumerate(zip(kinds, steps, points, strict=True))])


def _swept_cells(t: DataFrame, value: Column, weights: dict[str, Column], keys: list[str]) -> DataFrame:
    """Sums of the weights by keys, kind and cell, for rows that have a kind k."""
    at = value / F.col("k.step")
    cell = F.when(F.col("k.round"), F.rint(at)).otherwise(F.floor(at + 1e-9)).cast("int")
    rows = t.select(*keys, F.col("k.kind").alias("kind"), F.least(F.greatest(cell, F.lit(0)), F.col("k.points") - 1).alias("idx"), *[c.alias(n) for n, c in weights.items()])
    return rows.groupBy(*keys, "kind", "idx").agg(*[F.sum(n).alias(n) for n in weights])


def swept_two_body(pairs: DataFrame, grid: DataFrame, width: int, n: int, kinds: list[tuple], steps: list[float], points: list[int], keys: list[str] = KEY) -> DataFrame:
    """(structure_id, i, setting, features): two_body under several settings; grid (kind, setting, idx, g) with up to width channels. keys: structure_id alone sums a structure's atoms."""
    t = pairs.select(*keys, "z_i", "z_j", "r", F.explode(_kinds(kinds, steps, points)).alias("k")).filter(F.col("k.rcut") > F.col("r"))
    cells = _swept_cells(t, F.col("r"), {"w": S.mean_charge(F.col("z_i"), F.col("z_j")) * S.cutoff(F.col("r"), F.col("k.rcut"))}, keys)
    return from_cells(cells, grid, [(c, "w") for c in range(width)], ["kind", "idx"], [*keys, "setting"])


def swept_three_body(triples: DataFrame, grid: DataFrame, width: int, n: int, kinds: list[tuple], steps: list[float], points: list[int], keys: list[str] = KEY) -> DataFrame:
    """As swept_two_body, of three_body; n weights of an order. A triple counts where all its sides are within the cutoff: a far third side adds nothing there either."""
    sides = F.greatest("r_p", "r_q", "r_pq")
    t = triples.filter(sides < max(k[0] for k in kinds))
    t = t.select(*keys, "z_i", "z_p", "z_q", "r_p", "r_q", "r_pq", "cos2", "cos3", F.acos("cos1").alias("th"), F.explode(_kinds(kinds, steps, points)).alias("k")).filter(F.col("k.rcut") > sides)
    rcut, third = F.col("k.rcut"), F.col("r_pq")
    w = 2.0 * S.mean_charge(F.col("z_i"), F.col("z_p"), F.col("z_q")) / F.pow(F.col("r_p") * F.col("r_q") * third, F.col("k.power"))
    w = w * S.cutoff(F.col("r_p"), rcut) * S.cutoff(F.col("r_q"), rcut) * S.cutoff(third, rcut)
    t = t.withColumn("w", w)
    cells = _swept_cells(t, F.col("th"), {"w": F.col("w"), "wc": F.col("w") * F.col("cos2") * F.col("cos3")}, keys)
    return from_cells(cells, grid, [(c, "wc" if c % n == 0 else "w") for c in range(width)], ["kind", "idx"], [*keys, "setting"])


def four_body(quads: DataFrame, grid: DataFrame, g: G.Grid, rcut: float, power: float = 1.0, lookup: str = "floor") -> DataFrame:
    """Sum over three neighbours of their solid angle."""
    r = [F.col(f"r_{n}") for n in "pqs"]
    w = S.mean_charge(F.col("z_i"), *[F.col(f"z_{n}") for n in "pqs"]) / S.damping(power, *r)
    w = reduce(lambda a, x: a * S.cutoff(x, rcut), r, w)
    cells = _histogram(quads, S.solid_angle(vec("p"), vec("q"), vec("s")), g, {"w": w}, lookup)
    return from_cells(cells, grid, [(c, "w") for c in range(g.channels)], ["idx"])


def five_body(quints: DataFrame, grid: DataFrame, g: G.Grid, rcut: float, power: float = 1.0, lookup: str = "floor") -> DataFrame:
    """Sum over four neighbours of the angle of each to the plane of the other three."""
    names = "pqst"
    r = [F.col(f"r_{n}") for n in names]
    w = S.mean_charge(F.col("z_i"), *[F.col(f"z_{n}") for n in names]) / S.damping(power, *r)
    w = reduce(lambda a, x: a * S.cutoff(x, rcut), r, w)
    angles = F.array(*[S.out_of_plane(*[vec(n) for n in names if n != m], vec(m)) for m in names])
    rows = quints.select(*KEY, w.alias("w"), F.explode(angles).alias("psi"))
    cells = _histogram(rows, F.col("psi"), g, {"w": F.col("w")}, lookup)
    return from_cells(cells, grid, [(c, "w") for c in range(g.channels)], ["idx"])


#: Triples of neighbours that are measured together.
TOGETHER = 1 << 13


@lru_cache(maxsize=64)
def _few_triples(n: int) -> np.ndarray:
    return np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3).T


def _triples(n: int) -> Iterator[np.ndarray]:
    """The triples of n neighbours, three rows of places, in pieces."""
    if n <= 32:
        yield _few_triples(n)
        return
    every = combinations(range(n), 3)
    while piece := list(islice(every, TOGETHER)):
        yield np.array(piece, np.int64).T


def _binned(values: np.ndarray, weights: np.ndarray, g: G.Grid, lookup: str) -> np.ndarray:
    """The histogram of _histogram, for one centre."""
    at = values / g.step
    cell = np.clip((np.rint(at) if lookup == "round" else np.floor(at + 1e-9)).astype(np.int64), 0, g.points - 1)
    if lookup != "linear":
        return np.bincount(cell, weights, g.points)
    f = np.clip(at - cell, 0.0, 1.0)
    return np.bincount(cell, weights * (1 - f), g.points) + np.bincount(np.minimum(cell + 1, g.points - 1), weights * f, g.points)


def _solid_angles(v: np.ndarray, triples: np.ndarray, at: np.ndarray) -> np.ndarray:
    """scalars.solid_angle of triples of directions v; at: the cosines between directions."""
    p, q, s = triples
    return 2.0 * np.arctan2(np.abs((v[p] * np.cross(v[q], v[s])).sum(1)), np.maximum(1.0 + at[p, q] + at[p, s] + at[q, s], 1e-10))


def _out_of_plane(v: np.ndarray, r: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """scalars.out_of_plane of every neighbour (columns) to the plane of each triple (rows)."""
    a, b, c = (v[k] for k in triples)
    n = np.cross(b - a, c - a)
    size = np.sqrt((n * n).sum(1))[:, None] * r
    return np.where(size < 1e-10, 0.0, np.arccos(np.minimum(1.0, np.abs(n @ v.T) / np.maximum(size, 1e-10))))


def four_and_five_body(pairs: DataFrame, rcut: float, solid: G.Grid, plane: G.Grid | None, power: float = 1.0, lookup: str = "floor") -> DataFrame:
    """(structure_id, i, four, five): four_body and, if a plane grid is given, five_body from one pass over the centres' neighbours, no row a tuple. A quintuple is a triple, whose plane
    is made once, and each neighbour beside it, so its angles are an array of triples by neighbours."""
    sc, sent = pairs.sparkSession.sparkContext, [G.sample(g).T for g in (solid, plane) if g is not None]
    shared = sc.broadcast(sent)
    columns = ("z_j", "dx", "dy", "dz", "r")
    near = neighbor_arrays(pairs).select(*KEY, F.col("z_i").cast("double").alias("z_i"), *[F.col(f"near.{c}").cast("array<double>").alias(c) for c in columns])
    widths = [solid.channels, *([plane.channels] if plane is not None else [])]

    def centre(z_i: float, z: np.ndarray, v: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
        n, cut = len(r), 0.5 * (np.cos(S.PI * r / rcut) + 1.0) / r**power
        w4, w5 = z**0.25 * cut, z**0.2 * cut
        h4, h5 = np.zeros(solid.points), None if plane is None else np.zeros(plane.points)
        u = v / r[:, None]
        at = u @ u.T
        for t in _triples(n):
            p, q, s = t
            h4 += _binned(_solid_angles(u, t, at), z_i**0.25 * w4[p] * w4[q] * w4[s], solid, lookup)
            if plane is not None and n > 3:
                w = z_i**0.2 * (w5[p] * w5[q] * w5[s])[:, None] * w5
                np.put_along_axis(w, t.T, 0.0, 1)
                h5 += _binned(_out_of_plane(v, r, t).ravel(), w.ravel(), plane, lookup)
        return [h @ g for h, g in zip((h4, h5), shared.value)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = batch.column(3).offsets.to_numpy()
            flat = [batch.column(3 + k).values.to_numpy() for k in range(len(columns))]
            v, z_i = np.stack(flat[1:4], 1), batch.column(2).to_numpy()
            out = [np.zeros((batch.num_rows, w)) for w in widths]
            for k in range(batch.num_rows):
                a, b = begin[k], begin[k + 1]
                if b - a > 2:
                    for o, x in zip(out, centre(z_i[k], flat[0][a:b], v[a:b], flat[4][a:b])):
                        o[k] = x
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, o.size + 1, o.shape[1]), pa.int32()), pa.array(o.ravel())) for o in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=[*KEY, *("four", "five")[: len(out)]])

    kind = Y.StructType([*near.select(*KEY).schema.fields, *[Y.StructField(n, Y.ArrayType(Y.DoubleType())) for n in ("four", "five")[: len(widths)]]])
    return near.mapInArrow(each, kind)


#: The most atoms of molecules that are measured together, and the numbers of a piece of them.
SMALL, NUMBERS = 24, 1 << 18


def looked_up(values: np.ndarray, g: G.Grid, table: np.ndarray, lookup: str) -> np.ndarray:
    """The channels (points x channels in table) at each value, as _histogram and from_cells look them up."""
    at = values / g.step
    cell = np.clip((np.rint(at) if lookup == "round" else np.floor(at + 1e-9)).astype(np.int64), 0, g.points - 1)
    if lookup != "linear":
        return table[cell]
    f = np.clip(at - cell, 0.0, 1.0)[:, None]
    return table[cell] * (1.0 - f) + table[np.minimum(cell + 1, g.points - 1)] * f


def _by_owner(owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, c, n) for c in rows.T], 1)


@dataclass(frozen=True)
class Molecules:
    """Two- and three-body features of whole molecules in numpy, equal to two_body and molecular_three_body of symmetric triples. near: the cutoff of neighbours; rcut: of the cutoff
    function, or None; tables: the channels at the points of the grids (points x channels)."""

    near: float
    rcut: float | None
    power: float
    lookup: str
    grids: tuple[G.Grid, ...]
    tables: tuple[np.ndarray, ...]

    def cut(self, r: np.ndarray) -> np.ndarray | float:
        return 1.0 if self.rcut is None else 0.5 * (np.cos(S.PI * r / self.rcut) + 1.0)

    def pairs(self, owner: np.ndarray, n: int, r: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Sums over pairs by owner, of n; z: the product of both charges."""
        return _by_owner(owner, (np.sqrt(z) * self.cut(r))[:, None] * looked_up(r, self.grids[0], self.tables[0], self.lookup), n)

    def triples(self, owner: np.ndarray, n: int, p: np.ndarray, q: np.ndarray, r: tuple[np.ndarray, ...], z: np.ndarray) -> np.ndarray:
        """Sums over triples by owner: p and q point from the centre to both neighbours; r: the lengths of p, q and q - p; z: the product of the charges."""
        g, pq = self.grids[1], q - p
        cos = lambda a, b, size: np.clip((a * b).sum(1) / size, -1.0, 1.0)
        w = 2.0 * np.power(z, 1.0 / 3.0) / np.power(r[0] * r[1] * r[2], self.power) * self.cut(r[0]) * self.cut(r[1]) * self.cut(r[2])
        wc = w * cos(p, pq, -r[0] * r[2]) * cos(q, pq, r[1] * r[2])
        own = looked_up(np.arccos(cos(p, q, r[0] * r[1])), g, self.tables[1], self.lookup)
        return _by_owner(owner, own * np.where(np.arange(g.channels) % len(g.weights) == 0, wc[:, None], w[:, None]), n)

    def small(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(molecules, atoms, channels) of molecules of one size: x (molecules, atoms, 3), z (molecules, atoms)."""
        m, n = z.shape
        d = x[:, None] - x[:, :, None]
        r = np.sqrt((d * d).sum(3))
        met = (r > 0) & (r < self.near) & ~np.eye(n, dtype=bool) & np.isfinite(z)[:, :, None] & np.isfinite(z)[:, None]
        k, i, j = np.nonzero(met)
        out = [self.pairs(k * n + i, m * n, r[k, i, j], z[k, i] * z[k, j])]
        if len(self.grids) > 1:
            p, q = np.triu_indices(n, 1)
            k, i, at = np.nonzero(met[:, :, p] & met[:, :, q] & (r[:, p, q] > 0)[:, None])
            p, q = p[at], q[at]
            out.append(self.triples(k * n + i, m * n, d[k, i, p], d[k, i, q], (r[k, i, p], r[k, i, q], r[k, p, q]), z[k, i] * z[k, p] * z[k, q]))
        return np.hstack(out).reshape(m, n, -1)

    def large(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(atoms, channels) of one molecule of any size: a centre at a time, of whose neighbours, which near bounds, one meets the later ones."""
        out = np.zeros((len(z), sum(g.channels for g in self.grids)))
        for i in range(len(z)):
            d = x - x[i]
            r = np.sqrt((d * d).sum(1))
            own = np.flatnonzero((r > 0) & (r < self.near) & np.isfinite(z) & np.isfinite(z[i]))
            own = own[own != i]
            d, r, c = d[own], r[own], z[own]
            out[i, : self.grids[0].channels] = self.pairs(np.zeros(len(own), np.int64), 1, r, z[i] * c)[0]
            for k in range(len(own) - 1 if len(self.grids) > 1 else 0):
                far = np.sqrt(((d[k + 1 :] - d[k]) ** 2).sum(1))
                at = np.flatnonzero(far > 0)
                q = at + k + 1
                sides = (np.full(len(q), r[k]), r[q], far[at])
                out[i, self.grids[0].channels :] += self.triples(np.zeros(len(q), np.int64), 1, np.broadcast_to(d[k], (len(q), 3)), d[q], sides, z[i] * c[k] * c[q])[0]
        return out

    def features(self, sizes: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(atoms, channels) of molecules of sizes, whose atoms lie one after another."""
        begin = np.cumsum(sizes) - sizes
        out = np.zeros((len(z), sum(g.channels for g in self.grids)))
        for n in np.unique(sizes[sizes > 1]):
            own = begin[sizes == n]
            together = max(1, NUMBERS // int(n) ** 3)
            for at in range(0, len(own), together):
                places = own[at : at + together, None] + np.arange(n)
                if n <= SMALL:
                    out[places.ravel()] = self.small(x[places], z[places]).reshape(places.size, -1)
                else:
                    for one in places:
                        out[one] = self.large(x[one], z[one])
        return out


def of_molecules(atoms: DataFrame, near: float, rcut: float | None, power: float, lookup: str, *grids: G.Grid, finish: Callable | None = None, kind: str = "") -> DataFrame:
    """(structure_id, atom_id, z, features) of all atoms: two-body features and, if a second grid is given, three-body ones of symmetric triples, side by side. finish(structure_ids,
    sizes, z, features), of molecules whose atoms lie one after another, makes batches of rows of kind instead, where the features are. A molecule is gathered as a row, so
    atoms that are dealt by structure stay where they are, and no pair, triple or cell is a row. Elements aren't null."""
    columns = ("atom_id", "z", "x", "y", "zc")
    g = atoms.groupBy("structure_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("a"))
    rows = g.select("structure_id", *[F.col(f"a.{c}").alias(c) for c in columns[:2]], *[F.col(f"a.{c}").cast("array<double>").alias(c) for c in columns[2:]])
    shared = atoms.sparkSession.sparkContext.broadcast(Molecules(near, rcut, power, lookup, grids, tuple(np.ascontiguousarray(G.sample(g).T) for g in grids)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
                flat = [batch.column(k).flatten() for k in range(1, 6)]
                z, *x = (np.asarray(c.to_numpy(zero_copy_only=False), float) for c in flat[1:])
                f = shared.value.features(sizes, np.stack(x, 1), z)
                if finish is not None:
                    yield from finish(batch.column(0), sizes, z.astype(np.int64), f)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), flat[0], flat[1], arrays(f)], names=["structure_id", "atom_id", "z", "features"])

    fields = {f.name: f for f in atoms.schema.fields}
    whole = Y.StructType([*[Y.StructField(n, fields[n].dataType) for n in ("structure_id", "atom_id", "z")], Y.StructField("features", Y.ArrayType(Y.DoubleType()))])
    return rows.mapInArrow(each, kind or whole)


def legacy_four_body(quads: DataFrame, grid: DataFrame, g: G.Grid, power: float = 2.0, a: float = 1.0) -> DataFrame:
    """Sum over ordered neighbours of the product of Gaussians at the six distances, looked up at its mean by rounding."""
    r = [F.col(f"r_{n}") for n in ("p", "q", "s", "pq", "ps", "qs")]
    q = quads.withColumn("m", S.gaussian_fold(r, a))
    w = S.mean_charge(F.col("z_i"), *[F.col(f"z_{n}") for n in "pqs"]) * F.col("m.zeta") / S.damping(power, *r[:3])
    cells = _histogram(q, F.col("m.mu"), g, {"w": w}, "round")
    return from_cells(cells, grid, [(c, "w") for c in range(g.channels)], ["idx"])


def with_all_atoms(atoms: DataFrame, blocks: list[tuple[DataFrame, int]], whole: bool = False) -> DataFrame:
    """(structure_id, atom_id, z, features): blocks side by side for every atom, zeros where an atom has no tuple. whole: rows that are dealt by structure stay where they are, and an
    atom finds its block among its structure's, whose pairs have met there already; without it, rows are dealt anew by structure and atom."""
    out = atoms.select("structure_id", F.col("atom_id").alias("i"), "z")
    for k, (block, _) in enumerate(blocks):
        block = block.withColumnRenamed("features", f"b{k}")
        if whole:
            block = block.select(F.col("structure_id").alias("__s"), F.col("i").alias("__i"), f"b{k}")
            # two bounds and no equality, which would be a key of the join and need rows dealt by it
            met = (F.col("structure_id") == F.col("__s")) & (F.col("i") <= F.col("__i")) & (F.col("i") >= F.col("__i"))
            out = out.join(block.hint("merge"), met, "left").drop("__s", "__i")
        else:
            out = out.join(block, KEY, "left")
    parts = [F.coalesce(f"b{k}", F.array_repeat(F.lit(0.0), n)) for k, (_, n) in enumerate(blocks)]
    return out.select("structure_id", F.col("i").alias("atom_id"), "z", F.concat(*parts).alias("features"))


def two_body_gradient(pairs: DataFrame, grid: DataFrame, g: G.Grid, rcut: float | None) -> DataFrame:
    """(structure_id, i, wrt, gx, gy, gz): slopes of atom i's two-body features by the position of atom wrt, an array over channels for each axis.
    grid: (idx, g, slope). Each neighbour has a row; the atom itself has minus their sum. No cutoff function if rcut is None."""
    return pair_gradient(pairs.withColumn("idx", G.cell_of(F.col("r"), g)).join(F.broadcast(grid), "idx"), g, rcut)


def pair_gradient(rows: DataFrame, g: G.Grid, rcut: float | None) -> DataFrame:
    """As two_body_gradient, of pairs that have the grid's values (g) and slopes at their distance."""
    r, w = F.col("r"), S.mean_charge(F.col("z_i"), F.col("z_j"))
    cut, cut_slope = _cut(r, rcut)
    rows = rows.withColumn("__c", F.zip_with("g", "slope", lambda v, s: w * (cut_slope * v + cut * s) / r))
    axes = {"gx": "dx", "gy": "dy", "gz": "dz"}
    near = rows.select(*KEY, F.col("j").alias("wrt"), *[F.zip_with("__c", F.array_repeat(F.col(d), g.channels), lambda c, x: c * x).alias(n) for n, d in axes.items()])
    sums = near.groupBy(*KEY).agg(*[F.sum(F.get(n, F.lit(k))).alias(f"{n}{k}") for n in axes for k in range(g.channels)])
    own = sums.select(*KEY, F.col("i").alias("wrt"), *[F.array(*[-F.col(f"{n}{k}") for k in range(g.channels)]).alias(n) for n in axes])
    return near.union(own)


def _cut(r: Column, rcut: float | None) -> tuple[Column, Column]:
    return (F.lit(1.0), F.lit(0.0)) if rcut is None else (S.cutoff(r, rcut), S.cutoff_slope(r, rcut))


def side_slopes(triples: DataFrame, rcut: float | None, power: float, closed: bool) -> tuple[DataFrame, dict[str, Column]]:
    """(triples that count, columns): the weight __w, the product of the outer cosines __h and the angle __th of a triple, and what a change of side k (centre to p,
    centre to q, p to q) changes of each: __w0, __h0, __t0 and so on."""
    a, b, c = (F.col(n) for n in ("r_p", "r_q", "r_pq"))
    t = triples.filter(c < rcut) if rcut is not None and closed else triples
    sides = (a, b, c)
    cuts = [_cut(r, rcut) for r in sides]
    scale = 2.0 * S.mean_charge(F.col("z_i"), F.col("z_p"), F.col("z_q")) / F.pow(a * b * c, F.lit(power))
    cos1 = F.col("cos1")
    sin1 = F.sqrt(F.greatest(1.0 - cos1 * cos1, F.lit(1e-12)))
    # cosines at the centre, p and q by the law of cosines, and what they change by a side
    by_cos1 = [(a - b * cos1) / (a * b), (b - a * cos1) / (a * b), -c / (a * b)]
    at_p, at_q = (a * a + c * c - b * b) / (2.0 * a * c), (b * b + c * c - a * a) / (2.0 * b * c)
    by_p = [(a - c * at_p) / (a * c), -b / (a * c), (c - a * at_p) / (a * c)]
    by_q = [-a / (b * c), (b - c * at_q) / (b * c), (c - b * at_q) / (b * c)]
    w = scale * cuts[0][0] * cuts[1][0] * cuts[2][0]
    slopes_of_w = []
    for k, r in enumerate(sides):
        rest = [cuts[j][0] for j in range(3) if j != k]
        slopes_of_w.append(scale * rest[0] * rest[1] * (cuts[k][1] - power * cuts[k][0] / r))
    columns = {"__w": w, "__h": at_p * at_q, "__th": F.acos(cos1)}
    for k in range(3):
        columns |= {f"__w{k}": slopes_of_w[k], f"__h{k}": by_p[k] * at_q + at_p * by_q[k], f"__t{k}": -by_cos1[k] / sin1}
    return t, columns


def three_body_gradient(triples: DataFrame, grid: DataFrame, g: G.Grid, rcut: float | None, power: float = 2.0, closed: bool = True) -> DataFrame:
    """(structure_id, i, wrt, gx, gy, gz) as two_body_gradient, of the three-body features with linear lookup. triples: periodic_triples of pairs; an
    atom and its images are one atom. grid: slope_table. closed: pairs farther apart than rcut add nothing (three_body), or have the cutoff function like the
    others (molecular_three_body).

    A feature depends on the sides a, b (centre to p and q) and c of the triangle alone, so its slopes by a, b and c, each along its side,
    move p and q; the centre has minus their sum.
    """
    sides = (F.col("r_p"), F.col("r_q"), F.col("r_pq"))
    t, columns = side_slopes(triples, rcut, power, closed)
    t = t.select(*KEY, "j_p", "j_q", *sides, *[f"{x}_{n}" for n in "pq" for x in ("dx", "dy", "dz")], *[v.alias(n) for n, v in columns.items()])
    t = t.withColumn("idx", G.cell_of(F.col("__th"), g)).withColumn("__f", G.fraction_of(F.col("__th"), g)).join(F.broadcast(grid), "idx")
    n = len(g.weights)
    value = F.zip_with("g", "slope", lambda v, s: v + s * F.col("__f") * g.step)
    t = t.withColumn("__v", value)

    def by_side(k: int) -> Column:
        """The slope of every channel by a side."""
        plain = F.zip_with("__v", "slope", lambda v, s: F.col(f"__w{k}") * v + F.col("__w") * s * F.col(f"__t{k}"))
        return F.transform(F.zip_with(plain, "__v", lambda x, v: F.struct(x.alias("x"), v.alias("v"))), lambda y, at: F.when(at % n == 0, y["x"] * F.col("__h") + F.col("__w") * F.col(f"__h{k}") * y["v"]).otherwise(y["x"]))

    t = t.select(*KEY, "j_p", "j_q", *sides, *[f"{x}_{m}" for m in "pq" for x in ("dx", "dy", "dz")], *[by_side(k).alias(f"__s{k}") for k in range(3)])

    def step(side: int, x: str, name: str, other: str) -> Column:
        own, cross = F.col(f"{x}_{name}") / F.col(f"r_{name}"), (F.col(f"{x}_{name}") - F.col(f"{x}_{other}")) / F.col("r_pq")
        return F.zip_with(f"__s{side}", "__s2", lambda s, u: s * own + u * cross)

    def moved(name: str, side: int, other: str) -> Column:
        return F.struct(F.col(f"j_{name}").alias("wrt"), *[step(side, f"d{x}", name, other).alias(f"g{x}") for x in "xyz"])

    axes = ("gx", "gy", "gz")
    near = t.select(*KEY, F.explode(F.array(moved("p", 0, "q"), moved("q", 1, "p"))).alias("m")).select(*KEY, "m.*")
    back = near.select(*KEY, F.col("i").alias("wrt"), *[F.transform(x, lambda v: -v).alias(x) for x in axes])
    return summed_gradient(near.union(back), g.channels, ["structure_id", "i", "wrt"])


def _dot(weights: Column, values: Column, keep=None) -> Column:
    """Sum of products of two arrays, over the places that keep(place) holds for."""
    both = F.zip_with(weights, values, lambda a, b: a * b)
    if keep is not None:
        both = F.transform(both, lambda x, at: F.when(keep(at), x).otherwise(0.0))
    return F.aggregate(both, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def contracted(rows: DataFrame, value: Column, g: G.Grid, grid: DataFrame, first: int, parts: dict[str, Callable | None]) -> DataFrame:
    """rows with what a model of slopes (column __m, by channel, those of the block from first on) makes of the block's grid at value: for each part, a set of channels, its value there
    (the name) and change (d and the name). grid: slope_table. The sum over channels is taken here, so no later row has channels."""
    at = rows.withColumn("idx", G.cell_of(value, g)).withColumn("__f", G.fraction_of(value, g)).join(F.broadcast(grid), "idx")
    own = F.slice("__m", first + 1, g.channels)
    for name, keep in parts.items():
        at = at.withColumn(f"d{name}", _dot(own, F.col("slope"), keep)).withColumn(name, _dot(own, F.col("g"), keep) + F.col(f"d{name}") * F.col("__f") * g.step)
    return at.drop("idx", "__f", "g", "slope")


def _pushed(rows: DataFrame, *moves: tuple[str, list[Column]]) -> DataFrame:
    """(structure_id, atom_id, x, y, z): one row for each atom that a row moves."""
    each = F.array(*[F.struct(F.col(who).alias("atom_id"), *[v.alias(n) for v, n in zip(by, "xyz", strict=True)]) for who, by in moves])
    return rows.select("structure_id", F.explode(each).alias("m")).select("structure_id", "m.*")


def pair_pull(pairs: DataFrame, grid: DataFrame, g: G.Grid, rcut: float | None) -> DataFrame:
    """Slopes of a model's energy by atom positions through two-body features: pairs with __m -> (structure_id, atom_id, x, y, z), to be summed by atom."""
    r, (cut, cut_slope) = F.col("r"), _cut(F.col("r"), rcut)
    at = contracted(pairs, r, g, grid, 0, {"__a": None})
    c = S.mean_charge(F.col("z_i"), F.col("z_j")) * (cut_slope * F.col("__a") + cut * F.col("d__a")) / r
    at = at.withColumn("__c", c)
    d = [F.col("__c") * F.col(x) for x in ("dx", "dy", "dz")]
    return _pushed(at, ("j", d), ("i", [-x for x in d]))


def triple_pull(triples: DataFrame, grid: DataFrame, g: G.Grid, first: int, rcut: float | None, power: float = 2.0, closed: bool = True) -> DataFrame:
    """As pair_pull, through three-body features (periodic_triples with __m); channels from first on."""
    n = len(g.weights)
    t, columns = side_slopes(triples, rcut, power, closed)
    t = t.select("structure_id", "i", "j_p", "j_q", "r_p", "r_q", "r_pq", "__m", *[f"{x}_{m}" for m in "pq" for x in ("dx", "dy", "dz")], *[v.alias(k) for k, v in columns.items()])
    t = contracted(t, F.col("__th"), g, grid, first, {"__a": lambda at: at % n != 0, "__b": lambda at: at % n == 0})
    col = F.col
    for k in range(3):
        e = col(f"__w{k}") * (col("__a") + col("__h") * col("__b")) + col("__w") * ((col("d__a") + col("__h") * col("d__b")) * col(f"__t{k}") + col(f"__h{k}") * col("__b"))
        t = t.withColumn(f"__e{k}", e / col(("r_p", "r_q", "r_pq")[k]))
    p = [col("__e0") * col(f"{x}_p") + col("__e2") * (col(f"{x}_p") - col(f"{x}_q")) for x in ("dx", "dy", "dz")]
    q = [col("__e1") * col(f"{x}_q") + col("__e2") * (col(f"{x}_q") - col(f"{x}_p")) for x in ("dx", "dy", "dz")]
    return _pushed(t, ("j_p", p), ("j_q", q), ("i", [-(x + y) for x, y in zip(p, q, strict=True)]))


def summed_gradient(rows: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Gradient rows (gx, gy, gz arrays of width) summed by keys."""
    axes = ("gx", "gy", "gz")
    sums = rows.groupBy(*keys).agg(*[F.sum(F.get(x, F.lit(k))).alias(f"{x}{k}") for x in axes for k in range(width)])
    return sums.select(*keys, *[F.array(*[f"{x}{k}" for k in range(width)]).alias(x) for x in axes])
