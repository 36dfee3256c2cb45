"""Neighbour joins. Structures are the equality key, the distance is a residual, so every join is a keyed join.

Atoms come as (structure_id, atom_id, z, x, y, zc). Rows of the results are directed: centre i, neighbour j.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


#: Atoms above which periodic_pairs bins a structure if it is to choose.
LARGE = 512


def explode_atoms(s: DataFrame, *also: str) -> DataFrame:
    """STRUCTURES -> atoms, with other columns of the structure; charges and coords must have equal lengths."""
    both = F.arrays_zip(F.col("charges").alias("q"), F.col("coords").alias("p"))
    checked = F.when(F.size("charges") == F.size("coords"), both).otherwise(F.raise_error(F.lit("charges and coords differ in length")).cast("array<struct<q:double,p:array<double>>>"))
    a = s.select("structure_id", *also, F.posexplode(checked).alias("atom_id", "a"))
    return a.select("structure_id", *also, "atom_id", F.col("a.q").cast("int").alias("z"), *[F.col("a.p")[k].alias(n) for k, n in enumerate(("x", "y", "zc"))])


def _side(atoms: DataFrame, name: str) -> DataFrame:
    return atoms.select("structure_id", *[F.col(c).alias(f"{c}_{name}") for c in ("atom_id", "z", "x", "y", "zc")])


def gap(a: str, b: str) -> S.Vec:
    """Vector from side b to side a."""
    return tuple(F.col(f"{c}_{a}") - F.col(f"{c}_{b}") for c in ("x", "y", "zc"))


def molecular_pairs(atoms: DataFrame, rcut: float) -> DataFrame:
    """(structure_id, i, j, z_i, z_j, dx, dy, dz, r) of atoms of one molecule with 0 < r < rcut, in both directions; d points from centre to neighbour."""
    d = gap("j", "i")
    p = _side(atoms, "i").join(_side(atoms, "j"), "structure_id").filter(F.col("atom_id_i") != F.col("atom_id_j"))
    p = p.select("structure_id", F.col("atom_id_i").alias("i"), F.col("atom_id_j").alias("j"), "z_i", "z_j", *[c.alias(n) for c, n in zip(d, ("dx", "dy", "dz"), strict=True)])
    return p.withColumn("r", S.norm((F.col("dx"), F.col("dy"), F.col("dz")))).filter((F.col("r") > 0) & (F.col("r") < rcut))


def cell_columns(cell: Column) -> list[S.Vec]:
    return [tuple(cell[k][x] for x in range(3)) for k in range(3)]


def _along(across: S.Vec, volume: Column) -> Column:
    """The fraction of the cell of each atom along the axis that across is normal to the others of."""
    return F.transform("coords", lambda p: (p[0] * across[0] + p[1] * across[1] + p[2] * across[2]) / volume)


# Atoms and images are exploded from structures, whose size is all that Spark's estimate knows: without the hint a side of any size would be sent through the driver.


def images(s: DataFrame, rcut: float, *also: str) -> DataFrame:
    """(structure_id, also, nx, ny, nz, sx, sy, sz): the cells around a structure that can hold neighbours. Along an axis of height h, two atoms whose fractions
    of the cell differ by at most d meet only in images up to rcut / h + d, so the range is no wider than that, also for atoms outside their cell."""
    cell = cell_columns(F.col("cell"))
    volume = S.dot(cell[0], S.cross(cell[1], cell[2]))
    n = []
    for k, (a, h) in enumerate(zip("abc", S.cell_heights(cell, rcut), strict=True)):
        across = S.cross(cell[(k + 1) % 3], cell[(k + 2) % 3])
        fractions = _along(across, volume)
        spread = F.when((volume != 0) & (F.size("coords") > 0), F.array_max(fractions) - F.array_min(fractions)).otherwise(F.lit(0.0))
        n.append(F.when(F.col("pbc")[a], F.floor(F.lit(rcut) / h + spread + 1e-9).cast("int")).otherwise(F.lit(0)))
    out = s.select("structure_id", *also, "cell", *[c.alias(f"n_{a}") for c, a in zip(n, "abc", strict=True)])
    for a, name in zip("abc", ("nx", "ny", "nz"), strict=True):
        out = out.withColumn(name, F.explode(F.sequence(-F.col(f"n_{a}"), F.col(f"n_{a}"))))
    shift = S.image_shift((F.col("nx"), F.col("ny"), F.col("nz")), cell)
    return out.select("structure_id", *also, "nx", "ny", "nz", *[c.alias(k) for c, k in zip(shift, ("sx", "sy", "sz"), strict=True)])


def _images_of(atoms: DataFrame, cells: DataFrame, *also: str) -> DataFrame:
    """Atoms (side j) at every image of their structure."""
    place = [(F.col(f"{c}_j") + F.col(k)).alias(f"{c}_j") for c, k in zip(("x", "y", "zc"), ("sx", "sy", "sz"), strict=True)]
    return _side(atoms, "j").join(cells.hint("merge"), "structure_id").select("structure_id", *also, "atom_id_j", "z_j", "nx", "ny", "nz", *place)


PAIR = ["i", "j", "nx", "ny", "nz", "z_i", "z_j", "dx", "dy", "dz"]


def _measured(met: DataFrame, rcut: float, least: float) -> DataFrame:
    d = gap("j", "i")
    p = met.select("structure_id", F.col("atom_id_i").alias("i"), F.col("atom_id_j").alias("j"), "nx", "ny", "nz", "z_i", "z_j", *[c.alias(n) for c, n in zip(d, ("dx", "dy", "dz"), strict=True)])
    return p.withColumn("r", S.norm((F.col("dx"), F.col("dy"), F.col("dz")))).filter((F.col("r") > least) & (F.col("r") < rcut))


def periodic_pairs(s: DataFrame, rcut: float, split: bool | None = False, least: float = 1e-10) -> DataFrame:
    """As molecular_pairs over all periodic images, with the image (nx, ny, nz) of the neighbour; an atom is no neighbour of itself, but of its images.

    Without split a structure's pairs are made in one task and the result stays dealt by structure, which suits many structures of up to some
    hundred atoms. With split, atoms and images are binned by rcut and meet by bin, so that the work of a large structure grows with its
    atoms and is shared by many tasks, at the cost of one more shuffle; None bins the structures of more than LARGE atoms only, for tables
    that hold both kinds. All give the same rows. Pairs at a distance of at most least are left out.
    """
    if split is not False:
        return _binned_pairs(s, rcut, split is True, least)
    atoms = explode_atoms(s)
    p = _measured(_side(atoms, "i").join(_images_of(atoms, images(s, rcut)).hint("merge"), "structure_id"), rcut, least)
    home = (F.col("i") == F.col("j")) & (F.col("nx") == 0) & (F.col("ny") == 0) & (F.col("nz") == 0)
    return p.filter(~home)


def _binned_pairs(s: DataFrame, rcut: float, every: bool, least: float) -> DataFrame:
    """periodic_pairs by bins. Images beyond the cutoff around the box of a structure's atoms go before they are shuffled, and of (i, j, n) and (j, i, -n) one is
    measured and turned round. Structures that aren't binned meet in one bin. Structures are dealt first, so that the expressions that make them are planned and computed once
    and not again in every column that reads them."""
    s = s.select("structure_id", "charges", "coords", "cell", "pbc").repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "structure_id")
    axes = ["x", "y", "zc"]
    along = lambda k: F.transform("coords", lambda p: p[k])
    bounds = [f(along(k)).alias(f"{name}_{c}") for k, c in enumerate(axes) for name, f in (("low", F.array_min), ("high", F.array_max))]
    ends = [f"{name}_{c}" for c in axes for name in ("low", "high")]
    own = s.select("structure_id", "charges", "coords", "cell", "pbc", *bounds, (F.lit(every) | (F.size("coords") > LARGE)).alias("binned"))
    near = F.lit(True)
    for c in axes:
        near = near & (F.col(f"{c}_j") >= F.col(f"low_{c}") - rcut - 1e-6) & (F.col(f"{c}_j") <= F.col(f"high_{c}") + rcut + 1e-6)
    moved = _images_of(explode_atoms(s), images(own, rcut, "binned", *ends), "binned", *ends).filter(near).drop(*ends)
    left = explode_atoms(own, "binned").select("structure_id", "binned", *[F.col(c).alias(f"{c}_i") for c in ("atom_id", "z", *axes)])
    bin_of = lambda c, side: F.floor(F.col(f"{c}_{side}") / rcut)
    one = F.lit(0).cast("long")
    for c in axes:
        left = left.withColumn(f"bin_{c}", F.explode(F.when(F.col("binned"), F.array(*[bin_of(c, "i") + d for d in (-1, 0, 1)])).otherwise(F.array(one))))
        moved = moved.withColumn(f"bin_{c}", F.when(F.col("binned"), bin_of(c, "j")).otherwise(one))
    met = left.drop("binned").join(moved.drop("binned").hint("merge"), ["structure_id", *[f"bin_{c}" for c in axes]])
    same, n = F.col("atom_id_i") == F.col("atom_id_j"), [F.col(c) for c in ("nx", "ny", "nz")]
    ahead = (n[0] > 0) | ((n[0] == 0) & ((n[1] > 0) | ((n[1] == 0) & (n[2] > 0))))
    p = _measured(met.filter((F.col("atom_id_i") < F.col("atom_id_j")) | (same & ahead)), rcut, least)
    turned = {"i": F.col("j"), "j": F.col("i"), "z_i": F.col("z_j"), "z_j": F.col("z_i")}
    both = F.array(F.struct(*PAIR), F.struct(*[turned.get(c, 0 - F.col(c)).alias(c) for c in PAIR]))
    return p.select("structure_id", F.explode(both).alias("p"), "r").select("structure_id", *[F.col(f"p.{c}").alias(c) for c in PAIR], "r")


def neighbor_ordinal(pairs: DataFrame) -> DataFrame:
    """pairs with the place of each neighbour in its centre's list, from 1. The window is dealt by structure and centre; pairs that
    are dealt by structure already stay where they are."""
    image = [c for c in ("nx", "ny", "nz") if c in pairs.columns]
    return pairs.withColumn("ordinal", F.row_number().over(Window.partitionBy("structure_id", "i").orderBy("j", *image)))


def csr_offsets(pairs: DataFrame) -> DataFrame:
    """(structure_id, i, n, offset): neighbours of each centre and of the centres before it."""
    n = pairs.groupBy("structure_id", "i").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("structure_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def edges(pairs: DataFrame) -> DataFrame:
    """The graph of a structure: (structure_id, src, tgt, dist)."""
    return pairs.select("structure_id", F.col("i").alias("src"), F.col("j").alias("tgt"), F.col("r").alias("dist"))


def site_distance(atoms: DataFrame, site: tuple[float, float, float], near: float = 3.0, far: float = 5.0) -> DataFrame:
    """Distance of every atom to a place and its class: near, far or between."""
    r = S.norm(tuple(F.col(c) - float(v) for c, v in zip(("x", "y", "zc"), site, strict=True)))
    return atoms.select("structure_id", "atom_id", "z", r.alias("r")).withColumn("zone", F.when(F.col("r") < near, "near").when(F.col("r") > far, "far").otherwise("between"))


def nearest_layer(atoms: DataFrame, layers: DataFrame) -> DataFrame:
    """Each atom with the layer (layer_id, height) whose height is nearest to its third coordinate; ties go to the lower layer. Layers are a short list, broadcast."""
    both = atoms.crossJoin(F.broadcast(layers))
    best = F.min(F.struct(F.abs(F.col("height") - F.col("zc")).alias("gap"), F.col("layer_id")))
    return both.groupBy("structure_id", "atom_id").agg(best.alias("b")).select("structure_id", "atom_id", F.col("b.layer_id").alias("layer_id"), F.col("b.gap").alias("gap"))


def max_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row: rows that either side lacks, and the largest difference of the others."""
    both = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full")
    return both.agg(F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("unmatched"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("difference"))
