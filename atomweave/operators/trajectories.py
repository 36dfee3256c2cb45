"""Neighbours of the frames of trajectories, from one neighbour search for many frames.

Frames come as STRUCTURES with a column frame. Frames of a structure are taken in blocks by their number, without an order of all of them; in a block the first frame is the
reference of those after it, until an atom has moved by more than half the skin from it, or the cell, the elements or the periodic axes have
changed: that frame is the next reference. Two atoms come nearer by at most the skin while a reference lasts, so the pairs of a frame within the cutoff are
among those of its reference within cutoff plus skin: only references are searched, and every frame measures its reference's pairs anew. The rows are those of
`periodic_pairs` of every frame. A block bounds what one row gathers and lets a long trajectory be shared by many tasks, at one search a block at least.

Frames whose coordinates or charges are null have no pairs; repeated (structure_id, frame) are an error of the input and give each other's pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .pairs import periodic_pairs

FRAME = ["frame", "charges", "coords", "cell", "pbc"]


def _moved(a: Column, b: Column) -> Column:
    """The square of the largest step of an atom between two lists of coordinates of one length."""
    square = lambda p, q: sum(((p[k] - q[k]) * (p[k] - q[k]) for k in range(3)), F.lit(0.0))
    return F.coalesce(F.array_max(F.zip_with(a, b, square)), F.lit(0.0))


def references(frames: DataFrame, skin: float, block: int = 64, stride: int = 1) -> DataFrame:
    """frames with reference: the frame of the same structure and block whose neighbours serve this one. A block holds the frames of block * stride
    consecutive numbers; give the step between numbers as stride, so that blocks are full."""
    if block < 1 or stride < 1 or skin < 0:
        raise ValueError("a block has a frame, a stride is 1 or more, a skin isn't below 0")
    own = frames.filter(F.col("charges").isNotNull() & F.col("coords").isNotNull()).select("structure_id", *FRAME)
    packed = own.groupBy("structure_id", F.floor(F.col("frame") / (block * stride)).alias("block")).agg(F.array_sort(F.collect_list(F.struct(*FRAME))).alias("f"))

    def step(s: Column, f: Column) -> Column:
        r = s["at"]
        same = (r["charges"] == f["charges"]) & r["cell"].eqNullSafe(f["cell"]) & r["pbc"].eqNullSafe(f["pbc"])
        lasts = F.coalesce(same & (F.size(r["coords"]) == F.size(f["coords"])), F.lit(False)) & (_moved(r["coords"], f["coords"]) <= skin * skin / 4)
        at = F.when(lasts, r).otherwise(f)
        return F.struct(at.alias("at"), F.concat(s["of"], F.array(at["frame"])).alias("of"))

    start = F.struct(F.col("f")[0].alias("at"), F.slice(F.transform("f", lambda x: x["frame"]), 1, 0).alias("of"))
    of = F.aggregate("f", start, step, lambda s: s["of"])
    one = packed.select("structure_id", F.explode(F.arrays_zip("f", of.alias("reference"))).alias("x"))
    return one.select("structure_id", *[F.col(f"x.f.{c}").alias(c) for c in FRAME], F.col("x.reference").alias("reference"))


def candidates(referred: DataFrame, rcut: float, skin: float) -> DataFrame:
    """Pairs of the references within cutoff plus skin; structure_id is (structure_id, frame). Atoms at one place are pairs too, as they may part."""
    own = referred.filter(F.col("frame") == F.col("reference")).withColumn("structure_id", F.struct("structure_id", "frame"))
    return periodic_pairs(own, rcut + skin + 1e-9, least=-1.0)


def trajectory_pairs(frames: DataFrame, rcut: float, skin: float = 1.0, block: int = 64, stride: int = 1) -> DataFrame:
    """(structure_id, frame, i, j, nx, ny, nz, z_i, z_j, dx, dy, dz, r) of every frame, as periodic_pairs of each."""
    referred = references(frames, skin, block, stride)
    near = candidates(referred, rcut, skin).drop("dx", "dy", "dz", "r")
    key = F.struct("structure_id", F.col("reference").alias("frame"))
    each = referred.select(key.alias("structure_id"), F.col("frame").alias("now"), "coords", "cell")
    n, cell = [F.col(c) for c in ("nx", "ny", "nz")], F.col("cell")
    shift = lambda k: F.when(n[0].eqNullSafe(F.lit(0)) & (n[1] == 0) & (n[2] == 0), F.lit(0.0)).otherwise(n[0] * cell[0][k] + n[1] * cell[1][k] + n[2] * cell[2][k])
    d = [(F.col("coords")[F.col("j")][k] + shift(k) - F.col("coords")[F.col("i")][k]).alias(c) for k, c in enumerate(("dx", "dy", "dz"))]
    # exploded, so that the filter stays behind the join: as its condition, it has every coordinate written out twelve times, too much code to be compiled
    out = near.join(each.hint("merge"), "structure_id").select("structure_id.structure_id", F.col("now").alias("frame"), "i", "j", "nx", "ny", "nz", "z_i", "z_j", F.explode(F.array(F.struct(*d))).alias("d"))
    out = out.select(*[c for c in out.columns if c != "d"], "d.dx", "d.dy", "d.dz")
    return out.withColumn("r", S.norm((F.col("dx"), F.col("dy"), F.col("dz")))).filter((F.col("r") > 1e-10) & (F.col("r") < rcut))


def trajectory_work(frames: DataFrame, rcut: float, skin: float = 1.0, block: int = 64, stride: int = 1) -> DataFrame:
    """(structure_id, n_frames, n_references, measured): frames, how many of them were searched, and the pairs that were measured for all frames."""
    referred = references(frames, skin, block, stride)
    found = candidates(referred, rcut, skin).groupBy("structure_id").agg(F.count(F.lit(1)).alias("pairs"))
    served = referred.groupBy("structure_id", "reference").agg(F.count(F.lit(1)).alias("n"))
    both = served.select(F.struct("structure_id", F.col("reference").alias("frame")).alias("structure_id"), "n").join(found, "structure_id", "left")
    return both.groupBy("structure_id.structure_id").agg(F.sum("n").alias("n_frames"), F.count(F.lit(1)).alias("n_references"), F.coalesce(F.sum(F.col("n") * F.col("pairs")), F.lit(0)).alias("measured"))
