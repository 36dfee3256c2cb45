"""Findings of round 4."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from atomweave import entries
from atomweave.operators import features as B
from atomweave.operators import fits as FT
from atomweave.operators import grids as G
from atomweave.operators import kernels as K
from atomweave.operators import pairs as P
from atomweave.operators import pooling as L
from atomweave.operators import tuples as T
from atomweave.plans import features as PF


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_set_stand_in_the_order_of_their_kernel(spark, monkeypatch):
    """kernels stood in the order of identifiers, so files held a number of 8 bytes for each of all pairs."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(7, 3)), rng.normal(size=(5, 3))
    own = {"a": 0, "b": 1, "idsa": np.arange(7), "idsb": np.arange(10, 15), "xa": a, "xb": b}
    got = [x.column("k").to_numpy() for x in K._blocks(own, "laplacian", 0.3, 2, False)]
    assert len(got) == 1 and (np.diff(got[0]) >= 0).all()
    x = rng.normal(size=(90, 3))
    monkeypatch.setattr(K, "MAX_LANDMARKS", 20)
    monkeypatch.setattr(K, "SORTED", 40)
    monkeypatch.setattr(K, "ROWS", 7)
    rows = K.symmetric(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>"), 0.3).collect()
    assert len(rows) == len({(r.a_id, r.b_id) for r in rows}) == 90 * 90
    assert all(abs(r.k - np.exp(-0.3 * np.abs(x[r.a_id] - x[r.b_id]).sum())) < 1e-12 for r in rows)


def test_copies_of_groups_are_not_broadcast(spark, monkeypatch):
    """groups of marks, small enough to be broadcast, were copied for each group of rows and then broadcast, all through the driver."""
    monkeypatch.setattr(K, "MAX_LANDMARKS", 3)
    rows = spark.createDataFrame([(i, [i / 7.0, 1.0 - i / 5.0]) for i in range(60)], "id long, features array<double>")
    marks = rows.filter("id % 5 = 0")
    df = K.rectangulars(rows, marks, {"poly": ("polynomial", 0.5, 3), "rbf": ("rbf", 0.1, 2)})
    got = {(r.a_id, r.b_id): (r.poly, r.rbf) for r in df.collect()}
    assert len(got) == 60 * 12 and "Broadcast" not in plan_of(df)
    x = {i: np.array([i / 7.0, 1.0 - i / 5.0]) for i in range(60)}
    assert all(np.allclose(v, ((0.5 * x[a] @ x[b] + 1) ** 3, np.exp(-0.1 * ((x[a] - x[b]) ** 2).sum()))) for (a, b), v in got.items())
    sent = []
    monkeypatch.setattr(K, "MOST_COPIES", 4)
    deal = K.vector_groups
    monkeypatch.setattr(K, "vector_groups", lambda rows, n: sent.append(n) or deal(rows, n))
    assert K.rectangular(rows, marks, "laplacian", 0.3).count() == 60 * 12 and sent == [4, 4]
    df = K.symmetric(rows, 0.3)
    df.collect()
    assert "Broadcast" not in plan_of(df)


def test_molecules_are_measured_as_rows(spark, monkeypatch):
    """pairs, triples, cells and every channel of an atom were rows."""
    plan = plan_of(entries.molecular_features(spark, SF))
    assert "Join" not in plan and "posexplode" not in plan
    rng = np.random.default_rng(5)
    sizes = [1, 2, 5, 5, 9, 3]
    rows = [(k, i, int(rng.integers(1, 5)), *rng.uniform(0, 4, 3).tolist()) for k, n in enumerate(sizes) for i in range(n)]
    rows += [(4, 9, 2, *rows[-4][3:])]  # two atoms at one place
    atoms = spark.createDataFrame(rows, "structure_id long, atom_id int, z int, x double, y double, zc double").persist()
    for small, lookup, smooth in ((24, "floor", True), (2, "floor", True), (24, "linear", False), (4, "round", True)):
        monkeypatch.setattr(B, "SMALL", small)
        p = PF.Parameters(rcut=3.5, order=1, lookup=lookup, smooth=smooth, step=0.05, angle_step=0.05)
        rcut, two, three = p.rcut if smooth else None, p.radial(), p.angular()
        blocks = [(B.two_body(P.molecular_pairs(atoms, p.rcut), G.table(spark, two), two, rcut, lookup), two.channels)]
        blocks.append((B.molecular_three_body(T.molecular_triples(atoms, p.rcut), G.table(spark, three), three, rcut, p.damping, lookup), three.channels))
        by = lambda df: {(r.structure_id, r.atom_id, r.z): r.features for r in df.collect()}
        want, reps = by(B.with_all_atoms(atoms, blocks)), B.of_molecules(atoms, p.rcut, rcut, p.damping, lookup, two, three)
        got = by(reps)
        assert got.keys() == want.keys() and len(got) == len(rows)
        assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)
    monkeypatch.setattr(L, "FILLED", 100)
    for norm in (None, "mean", "max"):
        p = PF.Parameters(rcut=3.5, order=1, norm=norm, step=0.05, angle_step=0.05)
        bags = [{r.structure_id: r.features for r in df.collect()} for df in (PF.bagged_features(PF.molecular_features(atoms, p)), PF.molecular_bags(atoms, p))]
        assert bags[0].keys() == bags[1].keys() == set(range(6)) and all(np.allclose(bags[0][k], bags[1][k]) for k in bags[0])
        for r in PF.molecular_bags(atoms, p, digest=True).collect():
            assert r.n == len(bags[0][r.structure_id]) and np.isclose(r.total, np.abs(bags[0][r.structure_id]).sum())


@pytest.mark.parametrize(("fit", "rounds"), [(FT.Fit(0.01, [1e-2, 1.0], "rbf"), 14), (FT.Fit(0.1, [1e-3], "laplacian"), 40)])
def test_systems_of_many_rows_are_solved_in_few_steps(spark, fit, rounds):
    """beside its landmarks a system counted as alpha alone, however much of the kernel they left; and smooth kernels had a few landmarks for their whole series."""
    rng = np.random.default_rng(8)
    n, d = 400, 6
    x = rng.normal(size=(n, d))
    y = np.sin(x[:, 0]) + x[:, 1] * x[:, 2]
    rows = spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(n)], "id long, features array<double>, target double")
    rows = rows.withColumn("train", F.array(F.col("id") % 4 != 0)).withColumn("test", F.array(F.col("id") % 4 == 0)).persist()
    got = FT.exact(rows, [fit], FT.measure(rows, [fit]), 200, 200, 60, 1e-9, rounds, 0)
    train = np.arange(n) % 4 != 0
    k = fit.kernel(x, x[train])
    assert len(got) == len(fit.alphas)
    for _, a, mae, m, left in got:
        w = np.linalg.solve(k[train] + a * np.eye(train.sum()), y[train] - y[train].mean())
        want = np.abs(y[~train] - y[train].mean() - k[~train] @ w)
        assert m == len(want) and abs(mae - want.mean()) < 1e-6 and left < 1e-7, (a, mae, want.mean(), left)
    if fit.n_leading():
        z = fit.leading(x)
        own = fit.kernel(x, x) / np.exp(-fit.gamma * ((fit.own(x) ** 2).sum(1)[:, None] + (fit.own(x) ** 2).sum(1)))
        scaled = z / z[:, :1]
        third = 2 * fit.gamma * np.abs(fit.own(x) @ fit.own(x).T)
        assert z.shape[1] == fit.n_leading() and (np.abs(own - scaled @ scaled.T) <= third**3 * np.exp(third) / 6 + 1e-12).all()
