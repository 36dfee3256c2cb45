"""Findings of round 3."""

from itertools import combinations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from atomweave import entries
from atomweave.functions import scalars as S
from atomweave.operators import features as B
from atomweave.operators import grids as G
from atomweave.operators import kernels as K
from atomweave.operators import pairs as P
from atomweave.operators import tuples as T
from atomweave.plans import features as PF
from atomweave.sources import derived as D
from atomweave.streaming import features as ST


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_streams_of_a_cluster_checkpoint_below_the_shared_folder(spark, monkeypatch, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, -2.0]), (1, [3.0, 4.0]), (2, [0.0, 5.0])], "z int, features array<double>")
    rows.write.parquet(str(tmp_path / "rows"))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    q = ST.running_factors(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows")), "shared_factors")
    q.awaitTermination()
    assert {(r.z, r.channel): r.factor for r in spark.table("shared_factors").collect()} == {(1, 0): 2.0, (1, 1): 3.0, (2, 0): 1.0, (2, 1): 5.0}
    assert list((tmp_path / "shared").rglob("shared_factors/metadata"))


def test_no_exploded_side_goes_through_the_driver(spark):
    for name in ("mixed_size_neighbors", "crystal_neighbors", "periodic_pairs", "trajectory_neighbors"):
        assert "BroadcastHashJoin" not in plan_of(entries.QUERIES[name](spark, SF)), name


def test_kernels_of_one_pass_are_not_joined(spark, monkeypatch):
    df = entries.polynomial_rbf_kernels(spark, SF)
    assert "Join" not in plan_of(df) and "Exchange" not in plan_of(df)
    rows = spark.createDataFrame([(i, [i / 7.0, 1.0 - i / 5.0]) for i in range(9)], "id long, features array<double>")
    kernels = {"p": ("polynomial", 0.5, 3), "r": ("rbf", 0.3, 2)}
    want = {c: {(x.a_id, x.b_id): x.k for x in K.rectangular(rows, rows.filter("id % 2 = 0"), *k).collect()} for c, k in kernels.items()}
    for most in (2000, 3):
        monkeypatch.setattr(K, "MAX_LANDMARKS", most)
        got = K.rectangulars(rows, rows.filter("id % 2 = 0"), kernels).collect()
        assert len(got) == 45
        for x in got:
            assert (x.p, x.r) == pytest.approx((want["p"][x.a_id, x.b_id], want["r"][x.a_id, x.b_id]), rel=1e-12)


def test_matches_in_batches_are_those_of_one_at_a_time(spark):
    r = np.random.default_rng(3)
    for shape in ((8, 8, 70), (3, 5, 40), (1, 4, 9)):
        c = r.random(shape) * (r.random(shape) < 0.5)
        for gamma, rounds in ((0.5, 60), (1.0, 2), (0.05, 30)):
            want = [K.sinkhorn(c[:, :, k], gamma, rounds) for k in range(shape[2])]
            assert K.sinkhorns(c, gamma, rounds) == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert K.sinkhorns(np.zeros((0, 3, 2)), 1.0).tolist() == [0.0, 0.0]
    a, b = r.normal(size=(37, 5)), r.normal(size=(60, 5))
    assert (K.l1_matrix(a, b) == sum(np.abs(a[:, k : k + 1] - b[:, k]) for k in range(5))).all()
    # structures of several sizes, in several groups
    rows = [(s, i, int(r.integers(1, 3)), r.normal(size=4).tolist()) for s in range(9) for i in range(2 + s % 3)]
    atoms = spark.createDataFrame(rows, "structure_id long, atom_id int, z int, features array<double>")
    own = {s: [x for x in rows if x[0] == s] for s in range(9)}

    def one(s, t):
        c = np.exp(-K.l1_matrix(np.array([x[3] for x in own[s]]), np.array([x[3] for x in own[t]])) / 2.0)
        return K.sinkhorn(np.where(np.array([[x[2] == y[2] for y in own[t]] for x in own[s]]), c, 0.0), 0.5, 3)

    got = {(x.a_id, x.b_id): x.k for x in K.from_tiles(K.best_match_tiles(atoms, 2.0, 0.5, 3, 3)).collect()}
    assert len(got) == 81
    for (s, t), k in got.items():
        assert k == pytest.approx(one(min(s, t), max(s, t)) / np.sqrt(one(s, s) * one(t, t)), rel=1e-9)
    for x in K.best_match(atoms, atoms.filter(F.col("structure_id") % 3 == 0), 2.0, 0.5, 3).collect():
        assert x.k == pytest.approx(one(x.a_id, x.b_id), rel=1e-9)


@pytest.mark.parametrize("lookup", ["floor", "linear"])
def test_four_and_five_body_from_arrays(spark, lookup):
    pairs = P.periodic_pairs(D.crystals(spark, SF), 3.2).persist()
    solid, plane = G.solid(0.05), G.out_of_plane(0.05)
    want = [{(x.structure_id, x.i): x.features for x in df.collect()} for df in (B.four_body(T.neighbor_tuples(pairs, 3), G.table(spark, solid), solid, 3.2, 1.0, lookup), B.five_body(T.neighbor_tuples(pairs, 4), G.table(spark, plane), plane, 3.2, 1.0, lookup))]
    got = B.four_and_five_body(pairs, 3.2, solid, plane, 1.0, lookup).collect()
    assert len(got) == pairs.select("structure_id", "i").distinct().count() and want[1]
    for x in got:
        key = (x.structure_id, x.i)
        assert x.four == pytest.approx(want[0].get(key, [0.0] * solid.channels), rel=1e-9, abs=1e-12)
        assert x.five == pytest.approx(want[1].get(key, [0.0] * plane.channels), rel=1e-9, abs=1e-12)
    pairs.unpersist()


def test_many_neighbours_come_in_pieces():
    pieces = list(B._triples(45))
    assert max(p.shape[1] for p in pieces) <= B.TOGETHER < 45 * 44 * 43 // 6
    assert (np.hstack(pieces) == np.array(list(combinations(range(45), 3))).T).all()


def test_pair_forces_are_those_of_displaced_copies(spark):
    atoms = D.atoms(spark, SF).filter("structure_id < 60")
    energy = lambda a: P.molecular_pairs(a, 6.0).groupBy("structure_id").agg(F.sum(S.cutoff(F.col("r"), 6.0)).alias("energy"))
    want = {(r.structure_id, r.atom_id, r.axis): r.force or 0.0 for r in PF.forces(atoms, energy).collect()}
    df = PF.pair_forces(atoms, lambda r: S.cutoff(r, 6.0), 6.0)
    got = {(r.structure_id, r.atom_id, r.axis): r.force for r in df.collect()}
    assert got.keys() >= want.keys() and len(got) == 3 * atoms.count()  # atoms without a partner have no energy here
    assert all(got[k] == pytest.approx(want.get(k, 0.0), abs=1e-6) for k in got)
    assert "who" not in plan_of(entries.force_field(spark, SF))  # no structure is copied


def test_every_triple_has_a_row(spark):
    per_centre = P.molecular_pairs(D.atoms(spark, SF), 6.0).groupBy("structure_id", "i").count().selectExpr("sum(count * (count - 1) / 2) AS n").first().n
    df = entries.triple_join(spark, SF)
    assert {"p", "q"} <= set(df.columns) and 0 < df.count() <= per_centre
    assert df.groupBy("structure_id", "i", "p", "q").count().filter("count > 1").count() == 0


def test_groups_of_a_large_set_are_larger(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_LANDMARKS", 2)
    sizes = []
    tiles_of = K.tiles_of
    monkeypatch.setattr(K, "tiles_of", lambda groups, n, c: sizes.append(n) or tiles_of(groups, n, c))
    rows = spark.createDataFrame([(i, [i / 7.0, 1.0]) for i in range(90)], "id long, features array<double>")
    got = {(r.a_id, r.b_id): r.k for r in K.symmetric(rows, 0.5).collect()}
    assert sizes == [18] and len(got) == 8100  # groups of 5 and not of 2
    assert all(k == pytest.approx(np.exp(-abs(a - b) / 14.0)) for (a, b), k in got.items())
