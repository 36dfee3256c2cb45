"""Symmetry, supercells, rigid motion, closed forms and batches."""

import itertools
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from atomweave import entries
from atomweave.functions import scalars as S
from atomweave.operators import grids as G
from atomweave.operators import kernels as K
from atomweave.operators import models as M
from atomweave.operators import pairs as P
from atomweave.operators import pooling as L
from atomweave.operators import selection as X
from atomweave.operators import tuples as T
from atomweave.plans import features as PF
from atomweave.schema import STRUCTURES
from atomweave.sources import derived as D
from atomweave.sources import files
from atomweave.sources import fixtures as FX

SMALL = PF.Parameters(rcut=4.0, step=0.02, angle_step=0.02, order=1)


def by_atom(df):
    return {(r.structure_id, r.atom_id): np.array(r.features) for r in df.collect()}


def test_neighbor_counts_of_crystals(spark):
    n = {(r.structure_id, r.i): r.n for r in P.periodic_pairs(FX.structures(spark), 6.0).groupBy("structure_id", "i").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {n[0, i] for i in range(4)} == {78}
    assert {n[1, i] for i in range(2)} == {64}
    assert {n[2, i] for i in range(8)} == {46}
    assert {n[3, i] for i in range(8)} == {32}


@pytest.mark.parametrize("size,count", [(2, 496), (3, 4960)])
def test_tuple_counts(spark, size, count):
    p = P.periodic_pairs(FX.structures(spark, ["nacl_rocksalt"]), 6.0)
    n = T.neighbor_tuples(p, size).groupBy("i").count().collect()
    assert {r["count"] for r in n} == {count}


@pytest.mark.parametrize("size", [2, 3, 4])
def test_tuples_are_the_ordered_combinations(spark, size):
    """Neighbours come in any order and as several images of one atom; centres with too few neighbours have no tuple."""
    near = {(0, 0): [(2, 0), (1, 1), (1, 0), (1, -1), (3, 0)], (0, 1): [(0, 0)], (7, 0): [(1, 0), (2, 0), (2, 1), (0, 1)]}
    rows = [(s, i, j, nx, 0, 0, i + 1, j + 1, float(j), float(nx), 0.5, float(j + 10 * nx)) for (s, i), n in near.items() for j, nx in n]
    p = spark.createDataFrame(rows, "structure_id long, i int, j int, nx int, ny int, nz int, z_i int, z_j int, dx double, dy double, dz double, r double").repartition(3)
    names = "pqst"[:size]
    found = sorted((r.structure_id, r.i, tuple((r[f"j_{n}"], r[f"z_{n}"], r[f"dy_{n}"], r[f"r_{n}"]) for n in names), tuple(r[f"o_{n}"] for n in names)) for r in T.neighbor_tuples(p, size).collect())
    legs = lambda k: [(j, j + 1, float(nx), float(j + 10 * nx)) for j, nx in sorted(near[k])]
    assert found == sorted((*k, c, o) for k in near for c, o in zip(itertools.combinations(legs(k), size), itertools.combinations(range(1, len(near[k]) + 1), size), strict=True))
    assert T.neighbor_tuples(p.limit(0), size).count() == 0
    assert T.neighbor_tuples(P.neighbor_ordinal(p), size).count() == len(found)


def test_equivalent_atoms_and_different_ones(spark):
    f = by_atom(PF.periodic_features(FX.structures(spark, ["cu_fcc", "si_diamond", "nacl_rocksalt", "h2o_box", "ch4_box"]), SMALL))
    for s, atoms in ((0, range(4)), (2, range(8)), (3, range(4)), (3, range(4, 8)), (6, range(1, 5))):
        first = f[s, atoms[0]]
        assert all(np.abs(f[s, a] - first).max() < 1e-5 * max(1, np.abs(first).max()) for a in atoms)
    salt = by_atom(PF.periodic_features(FX.structures(spark, ["nacl_rocksalt"]), PF.Parameters(rcut=6.0, max_body=2, step=0.02, order=1)))
    assert np.abs(salt[3, 0] - salt[3, 4]).max() > 0.01
    assert np.abs(f[5, 0] - f[5, 1]).max() > 0.01


def test_supercell_keeps_features(spark):
    one = FX.structures(spark, ["cu_fcc", "triclinic"])
    a, b = by_atom(PF.periodic_features(one, SMALL)), by_atom(PF.periodic_features(FX.supercell(one, 2, 1, 1), SMALL))
    for (s, i), v in a.items():
        assert np.abs(b[s, i] - v).max() < 1e-5 * max(1, np.abs(v).max())


def test_rotation_translation_and_order_of_atoms(spark):
    t, w = 0.7, [[0.0, 0.0, 0.1173], [0.0, 0.7572, -0.4692], [0.0, -0.7572, -0.4692]]
    turned = [[math.cos(t) * x - math.sin(t) * y + 3, math.sin(t) * x + math.cos(t) * y - 1, z + 2] for x, y, z in w]
    rows = [(1, 0, 8, *w[0]), (1, 1, 1, *w[1]), (1, 2, 1, *w[2]), (2, 2, 8, *turned[0]), (2, 0, 1, *turned[1]), (2, 1, 1, *turned[2])]
    f = by_atom(PF.molecular_features(spark.createDataFrame(rows, "structure_id long, atom_id int, z int, x double, y double, zc double"), PF.Parameters(rcut=4.0, step=0.02, angle_step=0.02, order=1, lookup="linear")))
    assert np.allclose(f[1, 0], f[2, 2], atol=1e-6) and np.allclose(f[1, 1], f[2, 0], atol=1e-6)


def test_one_and_two_atoms_have_zero_or_two_body_features_only(spark):
    rows = [(1, 0, 6, 0.0, 0.0, 0.0), (2, 0, 6, 0.0, 0.0, 0.0), (2, 1, 8, 1.1, 0.0, 0.0), (3, 0, 1, 0.0, 0.0, 0.0), (3, 1, 1, 50.0, 0.0, 0.0)]
    f = by_atom(PF.molecular_features(spark.createDataFrame(rows, "structure_id long, atom_id int, z int, x double, y double, zc double"), PF.Parameters(rcut=4.0, order=0, step=0.05, angle_step=0.05)))
    assert not f[1, 0].any() and not f[3, 0].any()
    assert f[2, 0][:4].any() and not f[2, 0][4:].any()


def test_batch_equals_single_structures(spark):
    both = by_atom(PF.periodic_features(FX.structures(spark, ["fe_bcc", "triclinic"]), SMALL))
    for name in ("fe_bcc", "triclinic"):
        for k, v in by_atom(PF.periodic_features(FX.structures(spark, [name]), SMALL)).items():
            assert np.allclose(both[k], v)


def test_single_atom_in_small_cell_sees_its_images(spark):
    s = spark.createDataFrame([(1, [6.0], [[0.0] * 3], [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 2.0]], (True, True, True), None), (2, [6.0], [[0.0] * 3], [[2.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 0.0, 2.0]], (True, True, False), None)], STRUCTURES)
    n = {r.structure_id: r["count"] for r in P.periodic_pairs(s, 2.1).groupBy("structure_id").count().collect()}
    assert n == {1: 6, 2: 4}


def test_lengths_must_agree(spark):
    s = spark.createDataFrame([(1, [6.0, 1.0], [[0.0] * 3], None, None, None)], STRUCTURES)
    with pytest.raises(Exception, match="differ in length"):
        P.explode_atoms(s).collect()


def test_grid_by_transform_equals_direct_sum(spark):
    g = G.Grid(6.0, 60, (G.Weight("exp", 1.5), G.Weight("power", 3.0)), 3, 2.0, math.sqrt(2), 1, -2.0)
    fast = G.sample(g)
    for r in G.coarse(spark, g).collect():
        assert abs(fast[r.channel, r.idx] - r.value) < 1e-9


def test_fine_grid_sizes():
    assert (G.radial(10.0).points, G.radial(6.0).points, G.angular().points, G.solid().points, G.out_of_plane().points) == (12500, 7500, 15750, 6300, 3150)


def test_linear_and_floor_lookups_agree_on_fine_grids(spark):
    a = by_atom(PF.periodic_features(FX.structures(spark, ["triclinic"]), PF.Parameters(rcut=4.0, step=0.001, angle_step=0.001, order=0)))
    b = by_atom(PF.periodic_features(FX.structures(spark, ["triclinic"]), PF.Parameters(rcut=4.0, step=0.001, angle_step=0.001, order=0, lookup="linear")))
    for k, v in a.items():
        assert np.abs(b[k] - v).max() < 0.02 * max(1, np.abs(v).max())


def test_elements_change_features(spark):
    s = FX.structures(spark, ["nacl_rocksalt"])
    a = by_atom(PF.periodic_features(s, PF.Parameters(rcut=3.0, max_body=2, step=0.05)))
    b = by_atom(PF.periodic_features(s, PF.Parameters(rcut=3.0, max_body=2, step=0.05, by_element=True)))
    assert a[3, 0].shape == b[3, 0].shape and np.abs(a[3, 0] - b[3, 0]).max() > 1e-3


def test_parameters_are_checked():
    for bad in ({"max_body": 6}, {"lookup": "cubic"}, {"order": 5}, {"norm": "l2"}):
        with pytest.raises(ValueError):
            PF.Parameters(**bad)


def test_scalar_closed_forms(spark):
    x, y, z = [tuple(F.lit(float(v)) for v in e) for e in ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    row = spark.range(1).select(S.angle(x, y).alias("a"), S.solid_angle(x, y, z).alias("s"), S.out_of_plane(x, y, S.minus(x, S.minus(x, y)), z).alias("d"), S.out_of_plane(x, y, tuple(F.lit(0.0) for _ in range(3)), z).alias("o"), S.dihedral(x, y, z).alias("t")).first()
    assert row.a == pytest.approx(math.pi / 2)
    assert row.s == pytest.approx(math.pi / 2)
    assert row.d == 0.0 and row.o == pytest.approx(0.0)
    assert abs(row.t) == pytest.approx(math.pi / 2)
    assert [S.next_fast_len(n) for n in (13, 7500, 15707)] == [14, 7500, 15750]


def test_forces_match_the_slope_of_the_energy(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 0.0), (1, 1, 1, 1.3, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "structure_id long, atom_id int, z int, x double, y double, zc double")
    energy = lambda a: P.molecular_pairs(a, 4.0).groupBy("structure_id").agg(F.sum(S.cutoff(F.col("r"), 4.0)).alias("energy"))
    f = {(r.atom_id, r.axis): r.force for r in PF.forces(atoms, energy).collect()}
    want = 2 * -math.pi * math.sin(math.pi * 1.3 / 4) / 8
    assert f[1, 0] == pytest.approx(-want, rel=1e-5) and f[0, 0] == pytest.approx(want, rel=1e-5) and abs(f[0, 1]) < 1e-6


def test_force_field_covers_every_structure(spark):
    atoms = {r.structure_id: r["count"] for r in D.atoms(spark, SF).groupBy("structure_id").count().collect()}
    got = entries.force_field(spark, SF).collect()
    assert {(r.structure_id, r.axis): r.n for r in got} == {(i, axis): n for i, n in atoms.items() for axis in range(3)}
    assert all(abs(r.total) < 1e-3 for r in got)


def test_kernel_ridge_with_all_rows_is_exact(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, target double")
    p = {r.id: r.p for r in M.kernel_ridge(rows, 0.2, 0.1).predict(rows).collect()}
    k = np.exp(-0.2 * K.l1_matrix(x, x))
    want = k @ np.linalg.solve(k + 0.1 * np.eye(40), y)
    assert np.allclose([p[i] for i in range(40)], want, atol=1e-6)


def test_ridge_and_lasso_from_sums(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    y = x @ [1.0, 0.0, -2.0, 0.0] + 0.01 * rng.normal(size=200)
    rows = spark.createDataFrame([(i, a.tolist(), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, features array<double>, target double, fold int").repartition(3)
    m = M.moments(rows, by="fold")
    alpha, w = M.cross_validated(m, [0.01, 100.0])
    assert alpha == 0.01 and np.allclose(w, np.linalg.solve(x.T @ x + 0.01 * np.eye(4), x.T @ y))
    total = m[0] + m[1] + m[2] + m[3]
    assert np.flatnonzero(np.abs(M.lasso(total, 200, 0.1)) > 1e-6).tolist() == [0, 2]
    assert max(M.leave_one_out(m, 0.01), key=lambda t: t[1])[0] == 2


def test_best_match_of_a_structure_with_itself_is_largest(spark):
    rows = [(1, [1.0, 6.0], [[0.0, 1.0], [2.0, 2.0]]), (2, [1.0, 6.0], [[0.5, 1.0], [1.0, 2.0]]), (3, [8.0], [[0.0, 0.0]])]
    s = spark.createDataFrame(rows, "structure_id long, charges array<double>, atoms array<array<double>>")
    k = {(r.a_id, r.b_id): r.k for r in K.best_match(s, s, 1.0, 0.5).collect()}
    assert k[1, 1] > k[1, 2] and k[3, 3] == pytest.approx(1.0, abs=1e-6) and k[1, 3] < 1e-6 and k[1, 2] == pytest.approx(k[2, 1], rel=1e-3)
    assert K.sinkhorn(np.zeros((0, 3)), 1.0) == 0.0


def test_folds_split_and_prefixes(spark):
    rows = spark.range(103).withColumnRenamed("id", "k")
    sizes = sorted(r["count"] for r in X.folds(rows, "k", 5).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    assert {r.part: r["count"] for r in X.split(rows, "k").groupBy("part").count().collect()} == {"test": 21, "train": 82}
    p = X.prefixes(rows, "k", [5, 50, 500]).collect()
    assert {r.k for r in p if r.size == 5} < {r.k for r in p if r.size == 50} and not [r for r in p if r.size == 500]
    first = lambda seed: [r.k for r in X.sample(rows, "k", 20, seed).collect()]
    assert first(1) == first(1) != first(2)


def test_normalisation_of_unseen_elements(spark):
    reps = spark.createDataFrame([(1, 0, 6, [2.0, 0.0]), (1, 1, 6, [4.0, 0.0]), (2, 0, 8, [5.0, 1.0])], "structure_id long, atom_id int, z int, features array<double>")
    factors = L.element_norm_vectors(reps.filter("z = 6"), 2)
    kept = {(r.structure_id, r.atom_id): r.features for r in L.normalize(reps, factors, "keep").collect()}
    assert kept[1, 0] == [2 / 3, 0.0] and kept[2, 0] == [5.0, 1.0]
    assert L.normalize(reps, factors).count() == 2


def test_vacancy_and_slab(spark):
    s = FX.structures(spark, ["cu_fcc"])
    v = FX.vacancy(FX.supercell(s, 2, 2, 2)).first()
    assert len(v.charges) == len(v.coords) == 31
    f = by_atom(PF.periodic_features(FX.slab(FX.supercell(s, 1, 1, 3), 15.0), PF.Parameters(rcut=4.0, max_body=2, step=0.02, order=0)))
    inner, outer = f[0, 4], f[0, 0]
    assert np.abs(inner - outer).max() > 0.1


def test_files(spark, tmp_path):
    good = "2\ngdb 1\t" + "\t".join("0" for _ in range(11)) + "\t-1.5*^2\t0\nC\t0\t0\t1*^-1\t0\nH\t1\t0\t0\t0\n"
    (tmp_path / "a.xyz").write_text(good)
    (tmp_path / "b.xyz").write_text("x\n")
    (tmp_path / "c.xyz").write_text(good.replace("C\t", "Q\t"))
    rows = files.read_xyz(spark, str(tmp_path)).collect()
    assert [(r.charges, r.coords, r.energy) for r in rows] == [([6.0, 1.0], [[0.0, 0.0, 0.1], [1.0, 0.0, 0.0]], -150.0)]
    files.write(FX.structures(spark), str(tmp_path / "s"))
    assert files.read_structures(spark, str(tmp_path / "s")).count() == len(FX.crystals())
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for want in (1, 1):
        assert files.cached(spark, str(tmp_path / "cache"), {"rcut": 6.0}, make).count() == 3 and len(calls) == want
    files.cached(spark, str(tmp_path / "cache"), {"rcut": 5.0}, make)
    assert len(calls) == 2
    assert files.target_column(spark.createDataFrame([(1, 2.0)], "structure long, gap double")) == "gap"


def test_stream_of_structures(spark, tmp_path):
    from atomweave.streaming import features as ST

    files.write(FX.structures(spark, ["cu_fcc", "h2o_box"]), str(tmp_path / "in"))
    plan = lambda b: PF.periodic_features(b, PF.Parameters(rcut=3.0, max_body=2, step=0.05, order=0))
    stream = spark.readStream.schema(STRUCTURES).parquet(str(tmp_path / "in"))
    ST.each_batch(stream, plan, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    a, b = by_atom(spark.read.parquet(str(tmp_path / "out"))), by_atom(plan(FX.structures(spark, ["cu_fcc", "h2o_box"])))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_empty_inputs(spark):
    atoms = spark.createDataFrame([], "structure_id long, atom_id int, z int, x double, y double, zc double")
    assert PF.molecular_features(atoms, SMALL).count() == 0
    assert PF.periodic_features(spark.createDataFrame([], STRUCTURES), SMALL).count() == 0
