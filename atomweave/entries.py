"""Registered queries of the library. Each is thin: derive the input, apply an operator, round. SQL for them is in oracles.py."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import features as B
from .operators import grids as G
from .operators import kernels as K
from .operators import models as M
from .operators import networks as N
from .operators import pairs as P
from .operators import pooling as L
from .operators import selection as X
from .operators import stats as A
from .operators import trajectories as TR
from .operators import tuples as T
from .oracles import SQL
from .plans import evaluation as E
from .plans import features as PF
from .sources import derived as D
from .sources import files
from .sources import fixtures as FX
from .streaming import features as ST

QUERIES: dict = {}
RCUT = 6.0
NEAR = 4.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def R(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return F.when(c == 0, 0.0).otherwise(c)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """As R, of values from -1 to 1 where there are many: R writes each as a decimal, which takes longer than a kernel of 64 channels. A value within 1e-9 of the last digit of a tie may fall otherwise."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.signum(c) * F.floor(F.abs(c) * 10.0**digits + 0.5) / 10.0**digits
    return F.when(c == 0, 0.0).otherwise(c)


def squeezed(c: Column) -> Column:
    """sign(x) ln(1 + |x|), rounded: sums that span many powers of ten compare by their leading digits."""
    return R(F.signum(c) * F.log1p(F.abs(c)), 5)


def wide(grid: DataFrame) -> DataFrame:
    """(channel, idx, value) -> (idx, g)."""
    return grid.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda x: x["value"]).alias("g"))


COARSE = {
    "radial": G.Grid(RCUT, 120, (G.Weight("exp", 1.5), G.Weight("exp", 5.0), G.Weight("power", 3.0), G.Weight("power", 5.0)), 2, 2.0, math.sqrt(2.0), 1, 2.0),
    "angular": G.Grid(math.pi, 64, (G.Weight("cos", 1.0), G.Weight("cos", 2.0)), 2, 2.0, math.sqrt(2.0), 1, 2.0),
    "solid": G.Grid(2 * math.pi, 64, (G.Weight("cos", 1.0), G.Weight("cos", 2.0)), 2, 1.0, 1.0, 0, 1.0),
    "plane": G.Grid(math.pi, 64, (G.Weight("cos", 1.0), G.Weight("cos", 2.0)), 2, 1.0, 1.0, 0, 1.0),
    "legacy": G.Grid(RCUT, 120, (G.Weight("exp", 1.5), G.Weight("power", 2.0)), 2, 6.0, 6.0, 1, 1.0),
}


def coarse(spark: SparkSession, name: str) -> DataFrame:
    return wide(G.coarse(spark, COARSE[name]))


def pairs(spark: SparkSession, sf_dir: str, rcut: float = RCUT) -> DataFrame:
    return P.molecular_pairs(D.atoms(spark, sf_dir), rcut)


def long(features: DataFrame) -> DataFrame:
    return features.select("structure_id", "i", F.posexplode("features").alias("channel", "v")).select("structure_id", "i", "channel", squeezed(F.col("v")).alias("value"))


@query
def atoms(spark, sf_dir):
    a = D.atoms(spark, sf_dir)
    return a.select("structure_id", "atom_id", "z", R("x").alias("x"), R("y").alias("y"), R("zc").alias("zc"))


@query
def pair_join(spark, sf_dir):
    return pairs(spark, sf_dir).select("structure_id", "i", "j", "z_i", "z_j", R("r").alias("r"))


@query
def neighbor_ordinal(spark, sf_dir):
    return P.neighbor_ordinal(pairs(spark, sf_dir)).select("structure_id", "i", "j", "ordinal")


@query
def csr_offsets(spark, sf_dir):
    return P.csr_offsets(pairs(spark, sf_dir)).select("structure_id", "i", "n", "offset")


@query
def scalar_functions(spark, sf_dir):
    """Cutoffs, polynomials and bases of every pair's distance."""
    r = F.col("r")
    cols = {f"hermite{d}": S.hermite(r, d, 0.5) for d in range(1, 6)} | {f"chebyshev{d}": S.chebyshev(r / RCUT, d) for d in range(1, 6)}
    cols |= {"cutoff": S.cutoff(r, RCUT), "slope": S.cutoff_slope(r, RCUT), "charge": S.mean_charge(F.col("z_i"), F.col("z_j")), "damping": S.damping(2.0, r, r), "exponential": S.exponential_damping(-0.5, r, r), "basis": S.vdw_basis(r, F.lit(1.5), 2.0)}
    cols |= {"mu": S.gaussian_fold([r, 2.0 * r, F.lit(1.0)], 1.0)["mu"], "zeta": S.gaussian_fold([r, 2.0 * r, F.lit(1.0)], 1.0)["zeta"]}
    return pairs(spark, sf_dir, NEAR).select("structure_id", "i", "j", *[R(c, 5).alias(n) for n, c in cols.items()])


def _boxed(spark, sf_dir):
    s = D.structures(spark, sf_dir)
    cell = F.array(*[F.array(*[F.lit(10.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    return s.withColumn("cell", cell).withColumn("pbc", F.struct(*[F.lit(a != "c").alias(a) for a in "abc"]))


@query
def periodic_pairs(spark, sf_dir):
    """Atoms in a box of 10 that repeats along two axes: neighbours of each atom within 4."""
    p = P.periodic_pairs(_boxed(spark, sf_dir), NEAR)
    return p.groupBy("structure_id", "i").agg(F.count(F.lit(1)).alias("n"), R(F.sum("r"), 5).alias("sum_r"), F.sum(F.abs("nx") + F.abs("ny") + F.abs("nz")).alias("moves"))


@query
def crystal_neighbors(spark, sf_dir):
    p = P.periodic_pairs(D.crystals(spark, sf_dir), RCUT)
    return p.groupBy("structure_id", "i").agg(F.count(F.lit(1)).alias("n"), R(F.sum("r"), 5).alias("sum_r"))


@query
def mixed_size_neighbors(spark, sf_dir):
    """Crystals of 16 atoms, every tenth of them repeated to 576: the large ones are binned."""
    s, tenth = D.crystals(spark, sf_dir), F.col("structure_id") % 10 == 0
    p = P.periodic_pairs(s.filter(~tenth).unionByName(FX.supercell(s.filter(tenth), 3, 3, 4)), 4.15, split=None)
    return p.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), R(F.avg("r"), 5).alias("mean_r"))


@query
def trajectory_neighbors(spark, sf_dir):
    p = TR.trajectory_pairs(D.trajectories(spark, sf_dir), 4.15, 0.8)
    return p.groupBy("structure_id", "frame").agg(F.count(F.lit(1)).alias("n"), R(F.sum("r"), 4).alias("sum_r"))


@query
def supercell(spark, sf_dir):
    s = FX.supercell(D.crystals(spark, sf_dir), 2, 1, 3)
    return P.explode_atoms(s).groupBy("structure_id", "z").agg(F.count(F.lit(1)).alias("n"), R(F.sum("x"), 5).alias("sum_x"), R(F.sum("y"), 5).alias("sum_y"), R(F.sum("zc"), 5).alias("sum_z"))


MATRIX = [[1, 1, 0], [-1, 1, 0], [0, 1, 2]]


@query
def matrix_supercell(spark, sf_dir):
    """Crystals in a cell of combined cell vectors, four times as large."""
    s = FX.matrix_supercell(D.crystals(spark, sf_dir), MATRIX)
    cell = [F.get(F.get("cell", F.lit(r)), F.lit(r)) for r in range(3)]
    size = s.select("structure_id", R(cell[0] + 10 * cell[1] + 100 * cell[2], 5).alias("cell"))
    a = P.explode_atoms(s).groupBy("structure_id", "z").agg(F.count(F.lit(1)).alias("n"), *[R(F.sum(c), 4).alias(f"sum_{c}") for c in ("x", "y", "zc")])
    return a.join(size, "structure_id")


@query
def miller_slab(spark, sf_dir):
    """Two layers of each crystal on its plane (1 1 2), with vacuum: atoms, heights over the plane and the cell."""
    s = FX.miller_slab(D.crystals(spark, sf_dir), (1, 1, 2), 2, 10.0)
    up = F.col("cell")[2]
    long_ = F.sqrt(up[0] * up[0] + up[1] * up[1] + up[2] * up[2])
    heights = F.aggregate("coords", F.lit(0.0), lambda t, p: t + (p[0] * up[0] + p[1] * up[1] + p[2] * up[2]) / long_)
    a, b = F.col("cell")[0], F.col("cell")[1]
    across = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    area = F.sqrt(across[0] * across[0] + across[1] * across[1] + across[2] * across[2])
    return s.select("structure_id", F.size("charges").alias("n"), R(heights, 4).alias("heights"), R(long_, 5).alias("height"), R(area, 4).alias("area"), F.col("pbc.c").alias("open_side"))


@query
def two_body_sum(spark, sf_dir):
    """The flagship: neighbours, cutoff, grid lookup and sums by atom and channel."""
    g = COARSE["radial"]
    return long(B.two_body(pairs(spark, sf_dir), coarse(spark, "radial"), g, RCUT))


@query
def two_body_plain(spark, sf_dir):
    return long(B.two_body(pairs(spark, sf_dir), coarse(spark, "radial"), COARSE["radial"], None))


@query
def two_body_linear(spark, sf_dir):
    return long(B.two_body(pairs(spark, sf_dir), coarse(spark, "radial"), COARSE["radial"], RCUT, "linear"))


@query
def two_body_element(spark, sf_dir):
    """The radius of the neighbour's element picks the grid."""
    base = COARSE["radial"]
    grid = lambda radius: G.Grid(RCUT, 60, base.weights[:2], 2, radius**2, radius**2)
    return long(B.two_body(pairs(spark, sf_dir), G.element_table(spark, grid), grid(1.0), RCUT, "floor", True))


@query
def triple_join(spark, sf_dir):
    """All triples, a row each."""
    t = T.periodic_triples(pairs(spark, sf_dir))
    return t.select("structure_id", "i", F.col("j_p").alias("p"), F.col("j_q").alias("q"), R("r_pq").alias("r"), R("cos1", 5).alias("cos1"), R("cos2", 5).alias("cos2"), R("cos3", 5).alias("cos3"))


@query
def three_body_sum(spark, sf_dir):
    return long(B.three_body(T.periodic_triples(pairs(spark, sf_dir)), coarse(spark, "angular"), COARSE["angular"], RCUT))


@query
def molecular_three_body(spark, sf_dir):
    """Triples anchored at the lowest atom, feeding all three."""
    t = T.molecular_triples(D.atoms(spark, sf_dir), NEAR, "reference")
    return long(B.molecular_three_body(t, coarse(spark, "angular"), COARSE["angular"], None))


@query
def quad_solid_angle(spark, sf_dir):
    return long(B.four_body(T.neighbor_tuples(pairs(spark, sf_dir, NEAR), 3), coarse(spark, "solid"), COARSE["solid"], NEAR))


@query
def quint_out_of_plane(spark, sf_dir):
    return long(B.five_body(T.neighbor_tuples(pairs(spark, sf_dir, NEAR), 4), coarse(spark, "plane"), COARSE["plane"], NEAR))


@query
def legacy_four_body(spark, sf_dir):
    return long(B.legacy_four_body(T.ordered_quadruples(pairs(spark, sf_dir, 3.0)), coarse(spark, "legacy"), COARSE["legacy"]))


@query
def grid_convolutions(spark, sf_dir):
    out = None
    for name, g in COARSE.items():
        one = G.coarse(spark, g).select(F.lit(name).alias("grid"), "channel", "idx", R("value").alias("value"))
        out = one if out is None else out.union(one)
    return out


@query
def grid_gradient(spark, sf_dir):
    g = COARSE["radial"]
    return G.gradient(G.coarse(spark, g), g.step).select("channel", "idx", R("slope", 5).alias("slope"))


@query
def two_body_gradient(spark, sf_dir):
    """Slopes of every atom's two-body features by its own position."""
    g = COARSE["radial"]
    slopes = G.gradient(G.coarse(spark, g), g.step).groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("channel", "value", "slope"))).alias("a"))
    grid = slopes.select("idx", F.transform("a", lambda x: x["value"]).alias("g"), F.transform("a", lambda x: x["slope"]).alias("slope"))
    own = B.two_body_gradient(pairs(spark, sf_dir, NEAR), grid, g, RCUT).filter("i = wrt")
    rows = own.select("structure_id", "i", F.posexplode(F.arrays_zip("gx", "gy", "gz")).alias("channel", "a"))
    return rows.select("structure_id", "i", "channel", *[squeezed(F.col(f"a.{n}")).alias(n) for n in ("gx", "gy", "gz")])


def _vectors_long(spark, sf_dir):
    return D.long_form(D.vectors(spark, sf_dir), "id", "z")


@query
def global_pool(spark, sf_dir):
    """The sum of the vectors of each label."""
    s = L.vector_sum(D.vectors(spark, sf_dir), ["z"], 64)
    return s.select("z", F.posexplode("features").alias("channel", "v")).select("z", "channel", R("v", 5).alias("value"))


@query
def element_norm_factors(spark, sf_dir):
    rows = _vectors_long(spark, sf_dir)
    a, b = L.element_norm(rows, "mean"), L.element_norm(rows, "max").withColumnRenamed("factor", "largest")
    return a.join(b, ["z", "channel"]).select("z", "channel", R("factor").alias("factor"), R("largest").alias("largest"))


@query
def element_norm_apply(spark, sf_dir):
    """Factors of the even vectors applied to all; elements they lack pass unscaled."""
    v = D.vectors(spark, sf_dir)
    factors = L.element_norm_vectors(v.filter((F.col("id") % 2 == 0) & (F.col("z") != 3)), 64)
    out = L.normalize(v, factors, "keep")
    return D.long_form(out, "id").select("id", "channel", R("value").alias("value"))


@query
def bag_sort(spark, sf_dir):
    """Atoms of an order as a molecule, their coordinates as three channels."""
    a = D.atoms(spark, sf_dir).withColumn("z", F.col("z") % 5 + 1)
    rows = a.select("structure_id", "z", F.posexplode(F.array(R("x"), R("y"), R("zc"))).alias("channel", "value"))  # rounding keeps their order, and slots are many more
    return L.bag(rows, L.bag_sizes(a)).select("structure_id", "channel", "z", "slot", "value")


@query
def composition_filter(spark, sf_dir):
    s = X.composition(D.structures(spark, sf_dir), (2, 5), 83, 6)
    return s.select("structure_id", F.size("charges").alias("n_atoms"), F.size(F.array_distinct("charges")).alias("n_species"))


@query
def size_bins(spark, sf_dir):
    sizes = X.small(D.structures(spark, sf_dir), 12).select("structure_id", F.size("charges").alias("n_atoms"))
    return X.size_bins(sizes, [(1, 2), (3, 4), (5, 8), (9, 12)]).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("n_atoms").alias("atoms"))


@query
def atomization_target(spark, sf_dir):
    refs = spark.createDataFrame([(z, -0.5 * z * z) for z in range(1, 60)], "z int, energy double")
    return L.atomization(D.atoms(spark, sf_dir), D.targets(spark, sf_dir), refs).select("structure_id", R("energy", 3).alias("energy"))


@query
def centered_target(spark, sf_dir):
    return X.centered(D.targets(spark, sf_dir), "target").select("structure_id", R("target", 3).alias("target"))


@query
def random_sample(spark, sf_dir):
    return X.sample(D.targets(spark, sf_dir), "structure_id", 500).select("structure_id")


@query
def train_test_split(spark, sf_dir):
    return X.split(D.targets(spark, sf_dir), "structure_id").select("structure_id", "part")


@query
def kfold_assign(spark, sf_dir):
    return X.folds(D.targets(spark, sf_dir), "structure_id").select("structure_id", "fold")


@query
def learning_curve_prefix(spark, sf_dir):
    return X.prefixes(D.targets(spark, sf_dir), "structure_id", [100, 500, 1000, 10**9]).groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("structure_id").alias("ids"))


@query
def set_difference(spark, sf_dir):
    """Orders outside the sample, those in it, and the distinct elements of both."""
    t = D.targets(spark, sf_dir).select("structure_id")
    chosen = t.filter("structure_id % 3 = 0")
    a = D.atoms(spark, sf_dir).select("structure_id", "z")
    count = lambda ids, name: L.distinct_elements(X.gather(a, ids, "structure_id")).agg(F.count(F.lit(1)).alias("elements"), F.sum("z").alias("sum_z")).select(F.lit(name).alias("part"), "elements", "sum_z")
    return count(chosen, "in").union(count(X.without(t, chosen, "structure_id"), "out"))


@query
def standardize(spark, sf_dir):
    rows = _vectors_long(spark, sf_dir)
    out = A.standardize(rows.filter("id % 5 > 0"), rows.filter("id % 5 = 0"))
    return out.select("id", "channel", R("value", 5).alias("value"))


@query
def feature_corr(spark, sf_dir):
    return A.correlations_wide(D.vectors(spark, sf_dir), 64).select("a", "b", R("r").alias("r"))


@query
def feature_corr_counts(spark, sf_dir):
    return A.correlation_counts(A.correlations_wide(D.vectors(spark, sf_dir), 64), (0.2, 0.1, 0.05)).select("level", "n")


@query
def feature_variance(spark, sf_dir):
    return A.ranked(A.variances(_vectors_long(spark, sf_dir)), "variance").select("channel", R("variance").alias("variance"), "constant", "rank")


@query
def top_feature_sets(spark, sf_dir):
    ranks = A.ranked(A.variances(_vectors_long(spark, sf_dir)), "variance")
    return A.top_sets(ranks, [5, 10, 35]).select("size", "channel")


@query
def feature_importance(spark, sf_dir):
    """Mean variance of channels by block and order of the default layout."""
    rows = A.variances(_vectors_long(spark, sf_dir)).join(F.broadcast(X.labels(spark)), "channel").withColumn("importance", F.col("variance"))
    return A.importance(rows).select("block", "m", R("mean").alias("mean"))


@query
def feature_labels(spark, sf_dir):
    return X.labels(spark)


@query
def feature_subset(spark, sf_dir):
    """Radial channels of the lower orders, and the angular ones without the second weight."""
    keep = X.block(5, 4, most_order=2) + X.block(5, 4, skip_weight=1, offset=20)
    v = D.vectors(spark, sf_dir).select("id", F.posexplode(X.channels(F.col("features"), keep)).alias("place", "value"))
    return v.groupBy("id").agg(F.count(F.lit(1)).alias("n"), R(F.sum(F.col("value") * (F.col("place") + 1)), 5).alias("checksum"))


def _queries(rows, key):
    """The stated query set of rectangular kernels: identifiers divisible by 50, against all rows."""
    return rows.filter(F.col(key) % 50 == 0)


@query
def laplacian_kernel(spark, sf_dir):
    v = D.vectors(spark, sf_dir)
    return K.rectangular(v, _queries(v, "id"), "laplacian", 0.05).select("a_id", "b_id", rounded("k").alias("k"))


@query
def symmetric_kernel(spark, sf_dir):
    return K.symmetric(D.vectors(spark, sf_dir), 0.02).select("a_id", "b_id", rounded("k").alias("k"))


@query
def polynomial_rbf_kernels(spark, sf_dir):
    v = D.vectors(spark, sf_dir)
    both = K.rectangulars(v, _queries(v, "id"), {"poly": ("polynomial", 1.0 / 64, 3), "rbf": ("rbf", 0.1, 2)})
    return both.select("a_id", "b_id", R("poly", 5).alias("poly"), rounded("rbf").alias("rbf"))


def _molecules(spark, sf_dir):
    """Vectors as atoms: 8 to a structure, their label as element."""
    v = D.vectors(spark, sf_dir)
    return v.select(F.floor(F.col("id") / 8).cast("long").alias("structure_id"), (F.col("id") % 8).cast("int").alias("atom_id"), "z", "features")


@query
def delta_kernel(spark, sf_dir):
    m = _molecules(spark, sf_dir)
    return K.delta_kernel(m, _queries(m, "structure_id"), 16.0).select("a_id", "b_id", R("k").alias("k"))


@query
def local_kernel_l2(spark, sf_dir):
    m = _molecules(spark, sf_dir)
    return K.local_kernel(m, _queries(m, "structure_id"), 4.0, "l2").select("a_id", "b_id", "a_atom", "b_atom", R("c").alias("c"))


MATCH_ROUNDS = 60


@query
def best_match_kernel(spark, sf_dir):
    m = _molecules(spark, sf_dir)
    return K.best_match(m, _queries(m, "structure_id"), 16.0, 0.5, MATCH_ROUNDS).select("a_id", "b_id", R("k", 5).alias("k"))


@query
def best_match_cv(spark, sf_dir):
    """Kernel ridge by folds on the best-match kernel of all structures with themselves."""
    v = D.vectors(spark, sf_dir)
    m = _molecules(spark, sf_dir)
    target = v.groupBy(F.floor(F.col("id") / 8).cast("long").alias("id")).agg(F.sum(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)).alias("target"))
    return E.kernel_cv(K.best_match_tiles(m, 16.0, 0.5, MATCH_ROUNDS), target, [1e-3, 1e-1]).select("fold", "alpha", R("mae", 4).alias("mae"), "n_test")


def _errors(spark, sf_dir):
    """A table of settings, folds and errors: mean absolute difference of price and a guess by quantity."""
    li = D.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.col("l_extendedprice").alias("y"), "l_quantity")
    grid = F.explode(F.array(*[F.struct(F.lit(g).alias("gamma"), F.lit(a).alias("alpha")) for g in (800.0, 1000.0, 1200.0) for a in (0.0, 5000.0)]))
    rows = li.withColumn("s", grid).select("fold", "s.*", "y", (F.col("l_quantity") * F.col("s.gamma") + F.col("s.alpha")).alias("p"))
    return A.mae(rows, ["fold", "gamma", "alpha"])


@query
def fold_errors(spark, sf_dir):
    return A.fold_summary(_errors(spark, sf_dir), ["gamma", "alpha"]).select("gamma", "alpha", R("mean", 3).alias("mean"), R("sd", 3).alias("sd"))


@query
def grid_argmin(spark, sf_dir):
    return A.best_setting(_errors(spark, sf_dir), ["gamma", "alpha"], ["fold"]).select("fold", "gamma", "alpha", R("mae", 3).alias("mae"))


def _yearly(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("value"), F.count(F.lit(1)).alias("n"))


@query
def percent_change(spark, sf_dir):
    return A.percent_change(_yearly(spark, sf_dir), "year", "value").select("year", R("change", 5).alias("change"))


@query
def relative_improvement(spark, sf_dir):
    return A.against_first(_yearly(spark, sf_dir), "year", "value").select("year", R("improvement", 5).alias("improvement"))


@query
def log_extrapolation(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 7 + 1).alias("k")).agg(F.stddev_pop("o_totalprice").alias("s"))
    curve = o.select((F.col("k") * 1000).alias("n"), (F.col("s") / F.sqrt(F.col("k").cast("double"))).alias("mae"))
    return A.extrapolate(curve, 1000.0).select(R("slope").alias("slope"), R("n_goal", 1).alias("n_goal"))


@query
def describe_targets(spark, sf_dir):
    rows = D.structures(spark, sf_dir).join(D.targets(spark, sf_dir), "structure_id")
    d = A.describe(rows, F.size("charges"), F.col("target"))
    return d.select("n", "min_atoms", "max_atoms", R("mean_atoms").alias("mean_atoms"), R("min_target", 2).alias("min_target"), R("max_target", 2).alias("max_target"), R("mean_target", 2).alias("mean_target"))


@query
def median_by_priority(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").withColumn("seconds", F.col("o_totalprice"))
    return A.median_time(rows, ["o_orderpriority"]).select("o_orderpriority", R("median", 3).alias("median"))


@query
def component_errors(spark, sf_dir):
    """By element: mean absolute error and correlation of two coordinates."""
    a = D.atoms(spark, sf_dir)
    return a.groupBy("z").agg(R(F.avg(F.abs(F.col("y") - F.col("zc"))), 5).alias("mae"), R(F.corr("y", "zc"), 5).alias("r"))


@query
def site_distance(spark, sf_dir):
    d = P.site_distance(D.atoms(spark, sf_dir), (5.0, 5.0, 5.0))
    return d.groupBy("z", "zone").agg(F.count(F.lit(1)).alias("n"), R(F.sum("r"), 4).alias("sum_r"))


@query
def nearest_layer(spark, sf_dir):
    layers = spark.createDataFrame([(k, 1.0 + 2.5 * k) for k in range(4)], "layer_id int, height double")
    return P.nearest_layer(D.atoms(spark, sf_dir), layers).select("structure_id", "atom_id", "layer_id", R("gap", 5).alias("gap"))


@query
def layer_means(spark, sf_dir):
    rows = _vectors_long(spark, sf_dir).withColumn("layer", F.col("id") % 3)
    return A.layer_means(rows, ["z", "layer"]).select("z", "layer", R("norm", 5).alias("norm"))


@query
def group_spread(spark, sf_dir):
    return A.spread(_vectors_long(spark, sf_dir), ["z", "channel"]).select("z", "channel", R("spread").alias("spread"))


@query
def cross_run_difference(spark, sf_dir):
    """Two ways to correlate channels compared by key."""
    a = A.correlations_wide(D.vectors(spark, sf_dir), 64)
    b = A.correlations(_vectors_long(spark, sf_dir))
    return P.max_difference(a, b, ["a", "b"], "r").select("unmatched", R("difference").alias("difference"))


@query
def message_step(spark, sf_dir):
    nodes = D.atoms(spark, sf_dir).select("structure_id", "atom_id", F.array(F.col("z").cast("double"), F.col("x")).alias("features"))
    out = M.message_step(nodes, P.edges(pairs(spark, sf_dir, NEAR)), NEAR)
    return out.select("structure_id", "atom_id", R(F.get("features", F.lit(0)), 4).alias("f0"), R(F.get("features", F.lit(1)), 4).alias("f1"))


@query
def message_network(spark, sf_dir):
    """Two message steps over element and height, summed by structure."""
    nodes = D.atoms(spark, sf_dir).select("structure_id", "atom_id", F.array(F.col("z").cast("double"), F.col("x")).alias("features"))
    return M.message_network(nodes, P.edges(pairs(spark, sf_dir, NEAR)), NEAR, 2, [0.5, 2.0], whole=True).select("structure_id", R("p", 3).alias("p"))


def _wave(seed, out, into):
    return np.array(D.waves(seed, out, into)), np.array(D.waves(seed + 1, 1, out)[0])


#: Networks of width 3 and two steps, with fixed weights: from features, and from a vector of each element with factors by distance.
PLAIN_NETWORK = N.Network(NEAR, _wave(1, 3, 2), [[_wave(10, 3, 3), _wave(20, 3, 3)], [_wave(30, 3, 3), _wave(40, 3, 3)]], [[_wave(50, 3, 6), _wave(60, 3, 3)], [_wave(70, 3, 6), _wave(80, 3, 3)]], [_wave(90, 3, 3), _wave(100, 1, 3)])
ELEMENT_NETWORK = N.Network(NEAR, {z: np.array(D.waves(z, 1, 3)[0]) for z in range(1, 93)}, PLAIN_NETWORK.messages, PLAIN_NETWORK.updates, PLAIN_NETWORK.output, [_wave(110, 3, 1), _wave(120, 3, 3)])


def _network(spark, sf_dir, network):
    nodes = D.atoms(spark, sf_dir).select("structure_id", "atom_id", "z", F.array(F.col("z") / 92.0, F.col("x") / 10.0).alias("features"))
    return network.predict(nodes, P.edges(pairs(spark, sf_dir, NEAR)), whole=True).select("structure_id", R("p", 5).alias("p"))


@query
def weighted_network(spark, sf_dir):
    """A message network with weights over element and height of all atoms, summed by structure."""
    return _network(spark, sf_dir, PLAIN_NETWORK)


@query
def element_network(spark, sf_dir):
    """A message network that starts from element vectors and weighs messages by distance."""
    return _network(spark, sf_dir, ELEMENT_NETWORK)


@query
def feature_blocks(spark, sf_dir):
    """Two blocks of each vector side by side, padded to 40; vectors that are all zero in the first block are dropped."""
    v = D.vectors(spark, sf_dir)
    first = L.drop_zero_rows(v.select("id", F.transform(F.slice("features", 1, 4), lambda x: F.when(x > 0.1, x).otherwise(0.0)).alias("features")))
    both = L.concat_blocks(first, v.select("id", F.slice("features", 11, 6).alias("features")), ["id"])
    return both.select("id", F.posexplode(L.pad(F.col("features"), 40)).alias("place", "value")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), R(F.sum(F.col("value") * (F.col("place") + 1)), 5).alias("checksum"))


@query
def boxed_molecules(spark, sf_dir):
    """Molecules in an open box have the neighbours they have without it."""
    p = P.periodic_pairs(X.boxed(D.structures(spark, sf_dir)), NEAR)
    return p.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), R(F.sum("r"), 4).alias("sum_r"))


@query
def xyz_parse(spark, sf_dir):
    """XYZ texts built from orders: three atoms, one of an unknown element where the key divides by 7, an exponent in another notation where it divides by 5."""
    k = F.col("o_orderkey")
    props = F.concat_ws("\t", *[F.lit(str(i)) for i in range(12)], F.when(k % 5 == 0, F.concat(F.round(k / 8, 3).cast("decimal(20,3)").cast("string"), F.lit("*^-1"))).otherwise((k % 1000).cast("string")), F.lit("9"))
    line = lambda s, n: F.concat_ws("\t", s, (k % n).cast("string"), (k % (n + 3)).cast("string"), (k % (n + 7)).cast("string"), F.lit("0"))
    text = F.concat_ws("\n", F.lit("3"), props, line(F.lit("C"), 11), line(F.lit("H"), 13), line(F.when(k % 7 == 0, F.lit("Q")).otherwise(F.lit("O")), 17))
    m = files.parsed(D.table(spark, sf_dir, "orders"), text, "o_orderkey")
    x = lambda a, b: F.get(F.get("coords", F.lit(a)), F.lit(b))
    return m.select("o_orderkey", R("energy", 4).alias("energy"), F.aggregate("charges", F.lit(0.0), lambda s, v: s + v).alias("charge"), (x(0, 0) + x(1, 1) * 100 + x(2, 2) * 10000).alias("checksum"))


def _regression(spark, sf_dir):
    v = D.vectors(spark, sf_dir)
    f = lambda k: F.get("features", F.lit(k))
    return v.select("id", "features", (2 * f(0) - f(1) + f(2) * f(3) + F.sin(f(4))).alias("target"))


LANDMARKS = 200


@query
def kernel_ridge_cv(spark, sf_dir):
    """Kernel ridge in its Nystroem form, on any number of vectors."""
    return E.cross_validate(_regression(spark, sf_dir), 3, 0.01, nystroem=LANDMARKS).select("fold", R("mae", 4).alias("mae"), "n_test")


@query
def tuned_kernel_ridge_cv(spark, sf_dir):
    """Settings chosen on a subset of each fold's training side, then a fit on all of it."""
    return E.tuned_cross_validate(_regression(spark, sf_dir), [0.003, 0.03], [1e-3], 3, 200, nystroem=LANDMARKS).select("fold", "gamma", "alpha", R("mae", 4).alias("mae"), "n_test")


@query
def learning_curve(spark, sf_dir):
    return E.learning_curve(_regression(spark, sf_dir), [50, 200], (1, 2), 0.01, nystroem=LANDMARKS).select("size", R("mean", 4).alias("mean"), R("sd", 4).alias("sd"))


@query
def hyperparameter_sweep(spark, sf_dir):
    """Widths of the kernel by damping: a plan and an error each."""
    return E.settings(_regression(spark, sf_dir), [0.003, 0.03], [1e-3, 1e-1], nystroem=LANDMARKS).select("gamma", "alpha", R("mae", 4).alias("mae"), "n_test")


@query
def exact_kernel_ridge_cv(spark, sf_dir):
    """Kernel ridge on all vectors, each fold's whole system solved; residuals up to a millionth count as 0."""
    return E.cross_validate(_regression(spark, sf_dir), 3, 0.01, (1e-3, 1e-1)).select("fold", "alpha", R("mae", 4).alias("mae"), "n_test", R("residual", 6).alias("residual"))


@query
def kernel_kinds_cv(spark, sf_dir):
    """Exact models of the other kernels: rbf and polynomial widths by damping."""
    v = _regression(spark, sf_dir)
    out = E.settings(v, [0.001, 0.01], [1e-2, 1.0], ("rbf", "polynomial", "linear"))
    return out.select("kind", "gamma", "alpha", R("mae", 4).alias("mae"), "n_test")


ALPHAS = [0.1, 1.0, 10.0, 100.0]


@query
def ridge_predict(spark, sf_dir):
    """Ridge with an intercept on scaled features, alpha by the error of rows left out one at a time."""
    rows = _regression(spark, sf_dir)
    alpha, w, _ = M.ridge_left_out(rows, ALPHAS)
    return M.linear_predict(rows, w).select("id", R("p", 5).alias("p"), F.lit(alpha).alias("alpha"))


@query
def lasso_weights(spark, sf_dir):
    """The intercept is channel -1."""
    m = M.moments(X.folds(_regression(spark, sf_dir), "id", 5), M.ones_first, "fold")
    alpha, w = M.lasso_cv(m)
    return spark.createDataFrame([(k - 1, round(float(x), 4), round(alpha, 6)) for k, x in enumerate(w)], "channel int, weight double, alpha double")


@query
def leave_one_feature_out(spark, sf_dir):
    m = M.moments(X.folds(_regression(spark, sf_dir), "id", 4), by="fold")
    return spark.createDataFrame([(k, d) for k, d in M.leave_one_out(m, 1.0)], "channel int, rise double").select("channel", R("rise", 4).alias("rise"))


#: Sets of channels by block and order of the default layout, and the last channels, which it leaves out.
ABLATED = {n: k for n, k in E.block_sets().items() if not n.startswith("no ")} | {"every": list(range(64)), "rest": list(range(40, 64))}


@query
def feature_ablation(spark, sf_dir):
    m = M.moments(X.folds(_regression(spark, sf_dir), "id", 4), by="fold")
    return spark.createDataFrame(list(M.ablation(m, ABLATED, 1.0).items()), "features string, error double").select("features", R("error", 4).alias("error"))


@query
def kernel_ablation(spark, sf_dir):
    """Kernel models without each weight of the default layout, and of the channels that vary most."""
    v = _regression(spark, sf_dir)
    top = [r.channel for r in A.ranked(A.variances(D.long_form(v, "id")), "variance").orderBy("rank").select("channel").collect()]  # a row a channel
    sets = {n: k for n, k in E.block_sets(importance=top, tops=(10,)).items() if n.startswith(("all", "no radial", "top"))}
    return E.ablate(v, sets, 0.01, nystroem=LANDMARKS).select("features", "n_features", R("mae", 4).alias("mae"))


@query
def force_field(spark, sf_dir):
    """Forces of a pair energy on all structures, by central differences, and what they sum to by axis (0)."""
    f = PF.pair_forces(D.atoms(spark, sf_dir), lambda r: S.cutoff(r, RCUT), RCUT)
    return f.groupBy("structure_id", "axis").agg(F.count(F.lit(1)).alias("n"), R(F.sum("force"), 3).alias("total"), R(F.sum(F.abs("force")), 3).alias("size"))


@query
def periodic_features(spark, sf_dir):
    """All feature blocks of the crystals on grids of the plan's own step, summed by structure."""
    p = PF.Parameters(rcut=3.2, max_body=5, norm=None)
    f = PF.periodic_features(D.crystals(spark, sf_dir), p)
    return PF.global_features(f, 72).select("structure_id", F.posexplode("features").alias("channel", "v")).select("structure_id", "channel", squeezed(F.col("v")).alias("value"))


#: The settings of generated_crystals.
CRYSTAL = PF.Parameters(rcut=5.0, order=4, max_body=3, norm=None)


@query
def generated_crystals(spark, sf_dir):
    """Two- and three-body features of a crystal of 16 atoms for each supplier, on grids of the plan's own step, summed by structure."""
    f = PF.periodic_features(D.crystals(spark, sf_dir), CRYSTAL)
    return PF.global_features(f, 40).select("structure_id", F.posexplode("features").alias("channel", "v")).select("structure_id", "channel", squeezed(F.col("v")).alias("value"))


#: Settings of a sweep: two cutoffs, orders and dampings.
SWEPT = [PF.Parameters(rcut=r, order=o, damping=d, step=0.05, angle_step=0.05) for r in (4.0, 5.0) for o in (1, 3) for d in (1.0, 2.0)]


@query
def feature_sweep(spark, sf_dir):
    """Crystals' features under eight settings from one neighbour search, summed by structure."""
    f = PF.swept_features(D.crystals(spark, sf_dir), SWEPT, pooled=True)
    return f.select("setting", "structure_id", F.posexplode("features").alias("channel", "v")).select("setting", "structure_id", "channel", squeezed(F.col("v")).alias("value"))


#: A model of features for forces: its slopes by channel, and the settings of the features.
FORCED = PF.Parameters(rcut=4.0, order=1, step=0.05, angle_step=0.05, lookup="linear")
SLOPES = [(-1.0) ** k / (k + 1) for k in range(16)]


@query
def model_forces(spark, sf_dir):
    """Forces on all atoms of the orders through a linear model of their two- and three-body features."""
    f = PF.model_forces(D.atoms(spark, sf_dir), FORCED, SLOPES)
    return f.select("structure_id", "atom_id", *[squeezed(F.col(c)).alias(c) for c in ("fx", "fy", "fz")])


@query
def molecular_features(spark, sf_dir):
    """Features of the orders' atoms, normalised by element and bagged."""
    a = D.atoms(spark, sf_dir).withColumn("z", F.col("z") % 5 + 1)
    f = PF.molecular_bags(a, PF.Parameters(rcut=5.0, order=1, norm="mean", max_body=3, step=0.05, angle_step=0.05, damping=1.0), digest=True)
    return f.select("structure_id", "n", R("total", 3).alias("total"))


@query
def legacy_features(spark, sf_dir):
    """The 65 channels of the Gaussian-product form, summed by structure."""
    f = PF.legacy_features(D.atoms(spark, sf_dir), PF.Parameters(rcut=4.0, smooth=False, lookup="round", step=0.05, angle_step=0.05), 3.0)
    return PF.global_features(f, 65).select("structure_id", F.size("features").alias("n"), squeezed(F.aggregate("features", F.lit(0.0), lambda s, v: s + F.abs(v))).alias("total"))


@query
def stream_norm_factors(spark, sf_dir):
    """Element factors kept by a stream over the embeddings."""
    name = f"factors_{uuid.uuid4().hex}"
    stream = spark.readStream.schema("vec_id bigint, embedding array<float>, label int").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/embeddings.parquet*")
    q = ST.running_factors(stream.select(F.col("label").alias("z"), F.col("embedding").cast("array<double>").alias("features")), name)
    q.awaitTermination()
    return spark.table(name).select("z", "channel", R("factor").alias("factor"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_body_sum(spark, sf_dir)
