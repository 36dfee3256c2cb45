"""Pairs to triples, quadruples and quintuples of one centre. All are keyed by (structure, centre) and taken in neighbour
order, so a tuple appears once; centres with too few neighbours drop out. Tuples grow with a power of a
centre's neighbours, which the cutoff bounds, not with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .pairs import _side, gap

KEY = ["structure_id", "i"]


def vec(name: str) -> S.Vec:
    return tuple(F.col(f"{c}_{name}") for c in ("dx", "dy", "dz"))


def neighbor_arrays(pairs: DataFrame) -> DataFrame:
    """(structure_id, i, z_i, near): the neighbours of each centre as one ordered array."""
    order = ["ordinal"] if "ordinal" in pairs.columns else ["j", *[c for c in ("nx", "ny", "nz") if c in pairs.columns]]
    fields = [*order, *[c for c in ("j", "z_j", "dx", "dy", "dz", "r") if c not in order]]
    return pairs.groupBy(*KEY, "z_i").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("near"))


def neighbor_tuples(pairs: DataFrame, size: int) -> DataFrame:
    """Tuples of size neighbours p < q < s < t of each centre, with their vectors, distances and charges, suffixed by the letter.

    A centre's neighbours, which the cutoff bounds, become one ordered array, and a tuple takes each next neighbour from the rest of it: pairs are made
    once, and pairs that are dealt by structure already aren't shuffled, as a join by (structure, centre) would."""
    out = neighbor_arrays(pairs)
    done = [*KEY, "z_i"]
    for k, name in enumerate("pqst"[:size]):
        before = "0" if k == 0 else f"o_{'pqst'[k - 1]}"
        rest = "near" if k == 0 else f"slice(near, {before} + 1, size(near))"
        out = out.select(*done, "near", F.posexplode(F.expr(rest)).alias("at", "leg"))
        own = [f"{before} + at + 1 AS o_{name}", f"leg.j AS j_{name}", f"leg.z_j AS z_{name}", *[f"leg.{c} AS {c}_{name}" for c in ("dx", "dy", "dz", "r")]]
        out = out.selectExpr(*done, "near", *own)
        done += [o.rsplit(" ", 1)[1] for o in own]
    return out.drop("near")


def periodic_triples(pairs: DataFrame) -> DataFrame:
    """Neighbour pairs p < q of each centre with the distance between the two images and the three cosines; pairs at one place are dropped."""
    t = neighbor_tuples(pairs, 2)
    jk = S.minus(vec("q"), vec("p"))
    t = t.withColumn("r_pq", S.norm(jk)).filter(F.col("r_pq") >= 1e-10)
    return t.withColumn("cos1", S.cosine(vec("p"), vec("q"))).withColumn("cos2", S.clamp(S.dot(vec("p"), jk) / (F.col("r_p") * F.col("r_pq")))).withColumn("cos3", S.clamp(S.dot(jk, vec("q")) * -1.0 / (F.col("r_pq") * F.col("r_q"))))


def molecular_triples(atoms: DataFrame, rcut: float, anchor: str = "symmetric") -> DataFrame:
    """One row per triple of atoms and centre: (structure_id, i, z's, r_ij, r_ik, r_jk, cos_i, cos_j, cos_k), the centre's cosine first.

    anchor='reference': atoms i < j < k with r_ij and r_ik below rcut and r_jk free, each triple feeding all three atoms;
    anchor='symmetric': each centre with two neighbours below rcut, whatever the order of the atoms.
    """
    a, b, c = _side(atoms, "a"), _side(atoms, "b"), _side(atoms, "c")
    ab, ac, bc = gap("b", "a"), gap("c", "a"), gap("c", "b")
    t = a.join(b, "structure_id").filter(F.col("atom_id_a") < F.col("atom_id_b") if anchor == "reference" else F.col("atom_id_a") != F.col("atom_id_b"))
    t = t.withColumn("r_ab", S.norm(ab)).filter((F.col("r_ab") > 0) & (F.col("r_ab") < rcut))
    t = t.join(c, "structure_id").filter((F.col("atom_id_b") < F.col("atom_id_c")) & (F.col("atom_id_a") != F.col("atom_id_c")))
    t = t.withColumn("r_ac", S.norm(ac)).filter((F.col("r_ac") > 0) & (F.col("r_ac") < rcut)).withColumn("r_bc", S.norm(bc)).filter(F.col("r_bc") > 0)
    cos_a = S.clamp(S.dot(ab, ac) / (F.col("r_ab") * F.col("r_ac")))
    cos_b = S.clamp(S.dot(ab, bc) * -1.0 / (F.col("r_ab") * F.col("r_bc")))
    cos_c = S.clamp(S.dot(ac, bc) / (F.col("r_ac") * F.col("r_bc")))
    t = t.withColumn("cos_a", cos_a).withColumn("cos_b", cos_b).withColumn("cos_c", cos_c)

    def centre(i: str, j: str, k: str):
        r = lambda p, q: F.col("r_" + "".join(sorted(p + q)))
        return F.struct(F.col(f"atom_id_{i}").alias("i"), *[F.col(f"z_{x}").alias(f"z_{n}") for x, n in ((i, "i"), (j, "j"), (k, "k"))], r(i, j).alias("r_ij"), r(i, k).alias("r_ik"), r(j, k).alias("r_jk"), *[F.col(f"cos_{x}").alias(f"cos_{n}") for x, n in ((i, "i"), (j, "j"), (k, "k"))])

    centres = [centre("a", "b", "c")] + ([centre("b", "a", "c"), centre("c", "a", "b")] if anchor == "reference" else [])
    return t.select("structure_id", F.explode(F.array(*centres)).alias("t")).select("structure_id", "t.*")


def ordered_quadruples(pairs: DataFrame) -> DataFrame:
    """Ordered neighbours j, k, l of each centre, which may coincide, with the six distances between the four atoms."""
    q, done = neighbor_arrays(pairs), [*KEY, "z_i"]
    for name in "pqs":  # each from the whole array, so pairs that are dealt by structure aren't dealt anew by centre
        own = [f"at + 1 AS o_{name}", *[f"leg.{c} AS {c}_{name}" for c in ("j", "dx", "dy", "dz", "r")], f"leg.z_j AS z_{name}"]
        q = q.select(*done, "near", F.posexplode("near").alias("at", "leg")).selectExpr(*done, "near", *own)
        done += [o.rsplit(" ", 1)[1] for o in own]
    q = q.drop("near")
    for a, b in ("pq", "ps", "qs"):
        q = q.withColumn(f"r_{a}{b}", S.norm(S.minus(vec(a), vec(b))))
    return q
