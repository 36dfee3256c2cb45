"""Kernels, linear and kernel models, gradients and splits against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atomweave.functions import scalars as S
from atomweave.operators import fits as T
from atomweave.operators import kernels as K
from atomweave.operators import models as M
from atomweave.operators import pairs as P
from atomweave.operators import selection as X
from atomweave.plans import evaluation as E
from atomweave.plans import features as PF
from atomweave.schema import ATOMS, STRUCTURES
from atomweave.sources import files
from atomweave.sources import fixtures as FX

KIND = "id long, features array<double>, target double"


def regression(spark, n=60, p=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * rng.uniform(0.5, 4, p) + rng.normal(size=p)
    y = x @ rng.normal(size=p) + 3 + 0.3 * rng.normal(size=n)
    return x, y, spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], KIND).repartition(3)


def test_ridge_that_leaves_rows_out_equals_refits(spark):
    x, y, rows = regression(spark)
    alpha, w, errors = M.ridge_left_out(rows, [0.1, 10.0, 300.0])
    z = (x - x.mean(0)) / x.std(0)
    for a in (0.1, 10.0, 300.0):
        e = []
        for i in range(len(z)):
            k = np.arange(len(z)) != i
            # the intercept isn't damped: a column of ones without penalty
            d = np.hstack([np.ones((len(z), 1)), z])
            fit = np.linalg.solve(d[k].T @ d[k] + a * np.diag([0.0] + [1.0] * z.shape[1]), d[k].T @ y[k])
            e.append((y[i] - d[i] @ fit) ** 2)
        assert errors[a] == pytest.approx(np.mean(e), rel=1e-9)
    assert alpha == min(errors, key=errors.get)
    p = {r.id: r.p for r in M.linear_predict(rows, w).collect()}
    own = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert np.allclose([p[i] for i in range(len(y))], z @ own + y.mean())


def test_lasso_with_folds_equals_descent_on_rows(spark):
    x, y, rows = regression(spark, seed=3)
    rows = rows.withColumn("fold", F.col("id") % 3)
    alpha, w = M.lasso_cv(M.moments(rows, M.ones_first, "fold"), n_alphas=12)
    z = (x - x.mean(0)) / x.std(0)

    def descent(z, y, a):
        m, v = z.mean(0), np.zeros(z.shape[1])
        c, t = z - m, y - y.mean()
        for _ in range(2000):
            for k in range(len(v)):
                rho = c[:, k] @ (t - c @ v + c[:, k] * v[k])
                v[k] = np.sign(rho) * max(abs(rho) - len(y) * a, 0) / (c[:, k] @ c[:, k])
        return v, y.mean() - v @ m

    top = np.abs(z.T @ (y - y.mean())).max() / len(y)
    alphas = np.geomspace(top, top * 1e-3, 12)
    fold = np.arange(len(y)) % 3
    errors = [np.mean([((y[fold == f] - z[fold == f] @ v - b) ** 2).mean() for f in range(3) for v, b in [descent(z[fold != f], y[fold != f], a)]]) for a in alphas]
    best = alphas[int(np.argmin(errors))]
    v, b = descent(z, y, best)
    assert alpha == pytest.approx(best)
    assert np.allclose(x @ w[1:] + w[0], z @ v + b, atol=1e-5)


def test_models_beyond_the_landmarks_stay_in_groups(spark, monkeypatch):
    x, y, rows = regression(spark)
    assert len(M.kernel_ridge(rows, nystroem=10).marks) == 10
    want = {r.id: r.p for r in M.kernel_ridge(rows, 0.05, 0.1).predict(rows).collect()}
    monkeypatch.setattr(K, "MAX_LANDMARKS", 20)
    monkeypatch.setattr(T.exact_model, "__defaults__", ("laplacian", 2, 25, 20, 1e-10, 200))
    model = M.kernel_ridge(rows, 0.05, 0.1)
    assert isinstance(model, T.BlockModel) and model.n_groups == 3
    got = model.predict(rows.union(rows.limit(5))).collect()
    assert len(got) == 65 and all(r.p == pytest.approx(want[r.id], rel=1e-6) for r in got)
    monkeypatch.setattr(M, "MAX_WIDTH", 3)
    with pytest.raises(Exception, match="columns"):
        M.moments(rows)


@pytest.mark.parametrize("kind", ["laplacian", "rbf", "polynomial"])
def test_slopes_of_kernel_models(spark, kind):
    x, _, rows = regression(spark, 12, 3)
    model = M.kernel_ridge(rows, 0.1, 0.1, kind)
    at = x[0] + 0.01
    point = lambda v: spark.createDataFrame([(0, v.tolist())], "id long, features array<double>")
    got = model.slope(point(at)).first().slope
    value = lambda v: float((K.matrix(v[None], model.marks, kind, 0.1, 2) @ model.weights)[0])
    for k in range(3):
        h = np.eye(3)[k] * 1e-6
        assert got[k] == pytest.approx((value(at + h) - value(at - h)) / 2e-6, rel=1e-4, abs=1e-6)


def test_best_match_has_uniform_marginals_at_any_gamma():
    rng = np.random.default_rng(2)
    c = rng.uniform(0.2, 1, (4, 5))
    for gamma in (0.01, 0.1, 1.0):
        assert 0 < K.sinkhorn(c, gamma, 5000) <= 1
    assert K.sinkhorn(np.ones((3, 3)), 0.5) == pytest.approx(1.0)
    assert K.sinkhorn(np.eye(3), 0.01) == pytest.approx(1.0, abs=1e-6)  # the best match is the identity
    assert np.isfinite(K.sinkhorn(np.array([[0.5, 0.2], [0.0, 0.0]]), 0.01)) and K.sinkhorn(np.zeros((2, 2)), 0.01) == 0.0


def test_blocks_of_marks_cover_all(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, features array<double>")
    some = rows.filter("id % 2 = 0")
    for kind in ("laplacian", "rbf"):
        want = {(i, j): K.matrix(np.array([[i, 1.0]]), np.array([[j, 1.0]]), kind, 0.05)[0, 0] for i in range(40) for j in range(0, 40, 2)}
        for most in (2000, 7):
            monkeypatch.setattr(K, "MAX_LANDMARKS", most)
            got = {(r.a_id, r.b_id): r.k for r in K.rectangular(rows, some, kind).collect()}
            assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for most in (2000, 7):
        monkeypatch.setattr(K, "MAX_LANDMARKS", most)
        both = {(r.a_id, r.b_id): r.k for r in K.symmetric(rows).collect()}
        assert len(both) == 1600 and all(v == pytest.approx(np.exp(-0.05 * abs(i - j))) for (i, j), v in both.items())
    a = rows.select(F.col("id").alias("a_id"))
    got = K.in_blocks(rows, "id", lambda b: a.crossJoin(b.select(F.col("id").alias("b_id"))), 7)
    assert got.count() == 1600


def test_ranks_by_any_number_of_buckets(spark):
    rows = spark.range(3000)
    want = {r.id: r["rank"] for r in X.shuffled_rank(rows, "id", 5).collect()}
    assert {r.id: r["rank"] for r in X.shuffled_rank(rows, "id", 5, 3).collect()} == want and sorted(want.values()) == list(range(1, 3001))


def test_kernels_of_atoms_by_plain_loops(spark):
    rng = np.random.default_rng(5)
    atoms = [(s, i, int(rng.integers(1, 4)), rng.normal(size=3).tolist()) for s in range(6) for i in range(int(rng.integers(1, 5)))]
    d = spark.createDataFrame(atoms, "structure_id long, atom_id int, z int, features array<double>").repartition(3)
    marks = d.filter("structure_id % 2 = 0")
    c = {(s, t, i, j): np.exp(-np.abs(np.array(x) - np.array(y)).sum() / 2) for s, i, z, x in atoms for t, j, w, y in atoms if z == w and t % 2 == 0}
    got = {(r.a_id, r.b_id, r.a_atom, r.b_atom): r.c for r in K.local_kernel(d, marks, 2.0).collect()}
    assert got.keys() == c.keys() and all(got[k] == pytest.approx(c[k]) for k in c)
    total = {}
    for (s, t, _, _), v in c.items():
        total[s, t] = total.get((s, t), 0) + v
    got = {(r.a_id, r.b_id): r.k for r in K.delta_kernel(d, marks, 2.0).collect()}
    assert got.keys() == total.keys() and all(got[k] == pytest.approx(total[k]) for k in total)
    assert K.delta_kernel(d.limit(0), marks, 2.0).count() == 0 and K.delta_kernel(d, marks.limit(0), 2.0).count() == 0


@pytest.mark.parametrize("group,direct", [(100, 100), (9, 100), (9, 10)])
def test_folds_on_a_given_kernel(spark, group, direct):
    """In one tile or several, solved by one task, and by conjugate gradients."""
    x, y, rows = regression(spark, 40, 3)
    tiles = K.kernel_tiles(K.rectangular(rows, rows, "rbf", 0.05), rows, group)
    fold = {r.id: r.fold for r in X.folds(rows, "id", 4).collect()}
    f = np.array([fold[i] for i in range(40)])
    k = K.matrix(x, x, "rbf", 0.05)
    got = E.kernel_cv(tiles, rows.select("id", "target"), [0.1, 1.0], 4, direct=direct).collect()
    assert len(got) == 8
    for r in got:
        a, b = f != r.fold, f == r.fold
        w = np.linalg.solve(k[np.ix_(a, a)] + r.alpha * np.eye(a.sum()), y[a] - y[a].mean())
        assert r.mae == pytest.approx(np.abs(y[b] - y[a].mean() - k[np.ix_(b, a)] @ w).mean()) and r.n_test == b.sum() and r.residual < 1e-8
    with pytest.raises(Exception, match="identifiers"):
        E.kernel_cv(tiles, rows.filter("id > 0").select("id", "target"), [0.1], 4, direct=direct)


def test_tuning_by_fold(spark):
    _, _, rows = regression(spark, 40, 3)
    tuned = E.tuned_cross_validate(rows, [0.05], [0.1, 1e6], 2, 15).collect()
    plain = {r.fold: r.mae for r in E.cross_validate(rows, 2, 0.05, (0.1,)).collect()}
    assert all(r.alpha == 0.1 and r.mae == pytest.approx(plain[r.fold]) for r in tuned) and len(tuned) == 2


def plain_errors(x, y, train, test, fit, nystroem=None, order=None):
    """Errors of a fit's alphas, by numpy."""
    own = x if fit.keep is None else x[:, fit.keep]
    sd = own[train].std(0)
    z, m, out = (own - own[train].mean(0)) / np.where(sd > 0, sd, 1), y[train].mean(), []
    k = K.matrix(z[train], z[train], fit.kind, fit.gamma, fit.degree)
    for a in fit.alphas:
        w = np.linalg.solve(k + a * np.eye(train.sum()), y[train] - m)
        out.append(np.abs(y[test] - m - K.matrix(z[test], z[train], fit.kind, fit.gamma, fit.degree) @ w).mean())
    return out


FITS = [T.Fit(0.05, [1e-2, 1.0]), T.Fit(0.02, [0.1], "rbf", keep=[0, 2, 3]), T.Fit(0.1, [0.5], "polynomial")]


@pytest.mark.parametrize("direct", [1000, 10])
def test_many_exact_fits_at_once(spark, direct):
    """Kernels, channels and alphas together; by one task, and by conjugate gradients on tiles of some 60 rows. A constant channel, and rows that take no part."""
    x, y, rows = regression(spark, 180, 5)
    rows = rows.withColumn("features", F.transform("features", lambda v, i: F.when(i == 4, F.lit(2.0)).otherwise(v)))
    x = x.copy()
    x[:, 4] = 2.0
    i = F.col("id")
    dealt = rows.withColumn("train", F.array(i % 3 != 0, i % 4 != 1, i < 90)).withColumn("test", F.array(i % 3 == 0, i % 4 == 1, i >= 100))
    fits = [T.Fit(f.gamma, f.alphas, f.kind, f.degree, f.keep) for f in FITS]
    n = T.measure(dealt, fits)
    got = T.exact(dealt, fits, n, 60, direct, 50)
    ids = np.arange(180)
    sides = [(ids % 3 != 0, ids % 3 == 0), (ids % 4 != 1, ids % 4 == 1), (ids < 90, ids >= 100)]
    want = [(f, a, e, int(sides[f][1].sum())) for f, fit in enumerate(fits) for a, e in zip(fit.alphas, plain_errors(x, y, *sides[f], fit), strict=True)]
    assert n == 180 and [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2] == pytest.approx(w[2], rel=1e-6) and g[4] < 1e-6


def test_exact_fits_of_5000_rows_with_all_landmarks(spark):
    """Beyond what one task solves, with the default number of landmarks, against numpy's solution of the same systems."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 8))
    y = np.sin(x[:, 0]) + x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=5000)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(5000), "features": x.tolist(), "target": y}), "id long, features array<double>, target double")
    i = F.col("id")
    dealt = rows.withColumn("train", F.array(i % 5 != 0)).withColumn("test", F.array(i % 5 == 0)).persist()
    fits = [T.Fit(0.05, [0.1, 1.0])]
    got = T.exact(dealt, fits, T.measure(dealt, fits), 1250)
    dealt.unpersist()
    test = np.arange(5000) % 5 == 0
    want = plain_errors(x, y, ~test, test, T.Fit(0.05, [0.1, 1.0]))
    for g, w in zip(got, want, strict=True):
        assert g[3] == 1000 and g[2] == pytest.approx(w, rel=1e-6) and g[4] < 1e-7


def test_landmarks_of_all_rows_are_exact(spark):
    _, _, rows = regression(spark, 60, 4)
    a = {r.fold: r.mae for r in E.cross_validate(rows, 3, 0.05, (0.1,)).collect()}
    b = {r.fold: r.mae for r in E.cross_validate(rows, 3, 0.05, (0.1,), nystroem=100).collect()}
    assert a.keys() == b.keys() == {1, 2, 3} and all(a[f] == pytest.approx(b[f], rel=1e-5) for f in a)


def test_learning_curves_take_nested_prefixes(spark):
    x, y, rows = regression(spark, 60, 3)
    got = {r["size"]: (r["mean"], r["sd"]) for r in E.learning_curve(rows, [10, 30, 1000], (1, 2), 0.05, 0.1).collect()}
    want = {}
    for seed in (1, 2):
        rank = {r.id: r["rank"] for r in X.shuffled_rank(rows, "id", seed).collect()}
        r = np.array([rank[i] for i in range(60)])
        for size in (10, 30):
            want.setdefault(size, []).append(plain_errors(x, y, (r > 12) & (r <= 12 + size), r <= 12, T.Fit(0.05, [0.1]))[0])
    assert got.keys() == want.keys()
    for size, e in want.items():
        assert got[size][0] == pytest.approx(np.mean(e))


def test_sums_are_added_in_a_tree(spark):
    parts = spark.createDataFrame([(k % 2, 0, k, np.array([1.0, k]).tobytes()) for k in range(300)], T.SUMS).repartition(7)
    for rounds in (1, 2):
        got = T.added(parts, rounds)
        assert {k: v.tolist() for k, v in got.items()} == {0: [150.0, float(sum(range(0, 300, 2)))], 1: [150.0, float(sum(range(1, 300, 2)))]}


@pytest.mark.parametrize("group", [128, 3])
def test_best_match_tiles_are_the_matrix(spark, group):
    rng = np.random.default_rng(6)
    atoms = [(s, i, int(rng.integers(1, 3)), rng.normal(size=3).tolist()) for s in range(9) for i in range(int(rng.integers(1, 4)))]
    d = spark.createDataFrame(atoms, "structure_id long, atom_id int, z int, features array<double>").repartition(3)

    def one(s, t):
        a, b = ([(z, np.array(x)) for q, _, z, x in atoms if q == w] for w in (s, t))
        c = np.array([[np.exp(-np.abs(x - v).sum() / 2) if z == w else 0.0 for w, v in b] for z, x in a])
        return K.sinkhorn(c, 0.5)

    got = {(r.a_id, r.b_id): r.k for r in K.from_tiles(K.best_match_tiles(d, 2.0, 0.5, group=group)).collect()}
    assert len(got) == 81
    for (s, t), k in got.items():
        assert k == got[t, s] == pytest.approx(one(min(s, t), max(s, t)) / np.sqrt(one(s, s) * one(t, t)), rel=1e-9)
    part = {(r.a_id, r.b_id): r.k for r in K.best_match(d, d.filter("structure_id < 4"), 2.0, 0.5).collect()}
    assert len(part) == 36 and all(k == pytest.approx(one(s, t), rel=1e-9) for (s, t), k in part.items())


def test_ablation_by_kernel_models(spark):
    x, y, rows = regression(spark, 50, 4)
    got = {r.features: (r.n_features, r.mae) for r in E.ablate(rows, {"all": [0, 1, 2, 3], "two": [1, 3]}, 0.1, 0.01).collect()}
    part = {r.id: r.part for r in X.split(rows, "id", 0.2, 42).collect()}
    a = np.array([part[i] == "train" for i in range(50)])
    for name, keep in (("all", [0, 1, 2, 3]), ("two", [1, 3])):
        z = (x[:, keep] - x[a][:, keep].mean(0)) / x[a][:, keep].std(0)
        w = np.linalg.solve(K.matrix(z[a], z[a], "laplacian", 0.1) + 0.01 * np.eye(a.sum()), y[a] - y[a].mean())
        assert got[name] == (len(keep), pytest.approx(np.abs(y[~a] - y[a].mean() - K.matrix(z[~a], z[a], "laplacian", 0.1) @ w).mean()))
    sets = E.block_sets(importance=list(range(40)))
    assert len(sets["all"]) == 40 and len(sets["order<=1"]) == 16 and len(sets["no radial w=0"]) == 35 and sets["top5"] == [0, 1, 2, 3, 4]


def test_gradients_of_features_and_forces(spark):
    place = np.array([[0.0, 0, 0], [1.1, 0.2, 0.1], [0.3, 1.3, -0.4], [-0.8, 0.5, 1.0]])
    z = [6, 1, 8, 1]
    p = PF.Parameters(rcut=6.0, order=1, step=0.02, angle_step=0.02, lookup="linear", smooth=False)

    def atoms(x, s=1):
        return [(s, i, z[i], *map(float, v)) for i, v in enumerate(x)]

    h, rows = 1e-6, atoms(place, 0)
    for a in range(4):
        for axis in range(3):
            for sign in (1, -1):
                moved = place.copy()
                moved[a, axis] += sign * h
                rows += atoms(moved, 1 + 2 * (3 * a + axis) + (sign < 0))
    f = {(r.structure_id, r.atom_id): np.array(r.features) for r in PF.molecular_features(spark.createDataFrame(rows, ATOMS), p).collect()}
    one = spark.createDataFrame(atoms(place), ATOMS)
    gradient = PF.feature_gradients(one, p).persist()
    got = {(r.i, r.wrt): (r.gx, r.gy, r.gz) for r in gradient.collect()}
    for a in range(4):
        for axis in range(3):
            s = 1 + 2 * (3 * a + axis)
            for i in range(4):
                want = (f[s, i] - f[s + 1, i]) / (2 * h)
                assert np.allclose(got[i, a][axis], want, rtol=1e-4, atol=1e-4 * max(1, np.abs(want).max())), (i, a, axis)
    # forces through a kernel model of the summed features
    total = sum(f[0, i] for i in range(4))
    train = spark.createDataFrame([(k, (total * (1 + 0.1 * k)).tolist(), float(k)) for k in range(4)], KIND)
    model = M.kernel_ridge(train, 1e-3, 0.1, "rbf")
    summed = spark.createDataFrame([(1, total.tolist())], "id long, features array<double>")
    forces = {r.atom_id: (r.fx, r.fy, r.fz) for r in PF.kernel_forces(gradient, model.slope(summed)).collect()}
    energy = lambda s: float((K.matrix(sum(f[s, i] for i in range(4))[None], model.marks, "rbf", 1e-3, 2) @ model.weights)[0])
    for a in range(4):
        for axis in range(3):
            s = 1 + 2 * (3 * a + axis)
            assert forces[a][axis] == pytest.approx(-(energy(s) - energy(s + 1)) / (2 * h), rel=1e-3, abs=1e-4)


def test_split_pairs_are_the_same_pairs(spark, monkeypatch):
    s = FX.structures(spark).unionByName(spark.createDataFrame([(9, [6.0, 8.0], [[-7.0, 0.2, 9.1], [12.5, 3.3, -4.0]], [[3.0, 0.0, 0.0], [0.5, 4.0, 0.0], [0.0, 0.0, 5.0]], (True, False, True), None)], STRUCTURES))
    key = lambda df: sorted((r.structure_id, r.i, r.j, r.nx, r.ny, r.nz, round(r.r, 9)) for r in df.collect())
    plain = key(P.periodic_pairs(s, 4.0))
    assert plain == key(P.periodic_pairs(s, 4.0, split=True)) == key(P.periodic_pairs(s, 4.0, split=None))
    monkeypatch.setattr(P, "LARGE", 4)  # some are binned, some aren't
    assert plain == key(P.periodic_pairs(s.withColumn("binned", F.lit("x")), 4.0, split=None))
    odd = spark.createDataFrame([(2, [], [], [[3.0, 0.0, 0.0], [0.0, 3.0, 0.0], [0.0, 0.0, 3.0]], (True,) * 3, None)], STRUCTURES)
    assert P.periodic_pairs(odd, 4.0, split=True).count() == P.periodic_pairs(odd, 4.0).count() == 0
    # atoms outside their cell: every image within reach, by a plain loop
    x, cell = np.array([[-7.0, 0.2, 9.1], [12.5, 3.3, -4.0]]), np.array([[3.0, 0, 0], [0.5, 4.0, 0], [0, 0, 5.0]])
    want = sum(1 for i in range(2) for j in range(2) for a in range(-12, 13) for c in range(-8, 9) if not (i == j and a == c == 0) and 1e-10 < np.linalg.norm(x[j] - x[i] + a * cell[0] + c * cell[2]) < 4.0)
    assert sum(1 for r in plain if r[0] == 9) == want


def test_a_structure_of_thousands_of_atoms_beside_small_ones(spark):
    """The pairs of a repeated crystal are those of the crystal, times the repetitions; its work is shared by bins."""
    s = FX.structures(spark, ["cu_fcc", "triclinic"])
    large = FX.supercell(s.filter("structure_id = 0"), 10, 9, 8).withColumn("structure_id", F.lit(100).cast("long"))  # 2,880 atoms
    count = lambda df: {r.structure_id: (r.n, r.s) for r in df.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s")).collect()}
    plain, both = count(P.periodic_pairs(s, 4.2)), count(P.periodic_pairs(s.unionByName(large), 4.2, split=None))
    n, r = plain[0]
    assert both[100] == (n * 720, pytest.approx(r * 720)) and {k: v[0] for k, v in both.items() if k != 100} == {k: v[0] for k, v in plain.items()}


def test_legacy_features_have_65_channels(spark):
    rows = [(1, 0, 6, 0.0, 0.0, 0.0), (1, 1, 1, 1.1, 0.0, 0.0), (1, 2, 1, 0.0, 1.2, 0.1), (2, 0, 8, 0.0, 0.0, 0.0)]
    f = {(r.structure_id, r.atom_id): np.array(r.features) for r in PF.legacy_features(spark.createDataFrame(rows, ATOMS), PF.Parameters(rcut=4.0, smooth=False, lookup="round", step=0.05, angle_step=0.05)).collect()}
    assert all(len(v) == 65 for v in f.values()) and f[1, 0][40:].any() and not f[2, 0].any()


def test_small_helpers(spark, tmp_path):
    frames = spark.createDataFrame([(0, -1.5, [[0.0, 0.1, 0.2]], [[1.0, 2.0, 3.0]], [6])], "frame bigint, E double, F array<array<double>>, R array<array<double>>, z array<int>")
    frames.write.parquet(str(tmp_path / "md"))
    assert files.read_trajectory(spark, str(tmp_path / "md")).collect() == frames.collect()
    one = spark.range(1).select(S.efficiency(F.lit(0.5), F.lit(40)).alias("e"), S.per_million(F.lit(0.5), F.lit(2e6)).alias("m")).first()
    assert one.e == 20.0 and one.m == 0.25
    out = E.sweep([{"a": 1}, {"a": 2}], lambda s: spark.range(s["a"]).withColumnRenamed("id", "n"))
    assert sorted((r.a, r.n) for r in out.collect()) == [(1, 0), (2, 0), (2, 1)]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert X.gather(rows, spark.createDataFrame([(2,)], "id long"), "id").first().v == "y"
