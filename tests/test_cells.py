"""Cells of combined vectors, slabs on lattice planes, networks with weights."""

import itertools
import random

import numpy as np
import pytest

from atomweave.operators import networks as N
from atomweave.operators import pairs as P
from atomweave.plans import features as PF
from atomweave.schema import ATOMS
from atomweave.sources import fixtures as FX

SMALL = PF.Parameters(rcut=4.0, max_body=3, order=1, step=0.05, angle_step=0.05)


@pytest.mark.parametrize("seed", range(40))
def test_lattice_points_of_a_cell(seed):
    rnd = random.Random(seed)
    m = [[rnd.randint(-3, 3) for _ in range(3)] for _ in range(3)]
    det = round(np.linalg.det(np.array(m)))
    if det == 0:
        with pytest.raises(ValueError, match="inverse"):
            FX.hermite_normal_form(m)
        return
    h = FX.hermite_normal_form(m)
    assert all(h[r][c] == 0 for r in range(3) for c in range(r)) and all(h[k][k] > 0 for k in range(3)) and h[0][0] * h[1][1] * h[2][2] == abs(det)
    change = np.array(h) @ np.linalg.inv(np.array(m))
    assert np.allclose(change, np.rint(change)) and abs(round(np.linalg.det(change))) == 1
    got = FX.cosets(m)
    inverse = np.linalg.inv(np.array(m))
    want = [list(n) for n in itertools.product(range(-9, 10), repeat=3) if all(-1e-9 <= x < 1 - 1e-9 for x in np.array(n) @ inverse)]
    assert got == sorted(want) and len(got) == abs(det)


def test_atoms_keep_their_surroundings_in_a_larger_cell(spark):
    s = FX.structures(spark, ["triclinic"])
    m = [[1, 1, 0], [0, 2, -1], [1, 0, 1]]
    one = {r.atom_id: np.array(r.features) for r in PF.periodic_features(s, SMALL).collect()}
    large = PF.periodic_features(FX.matrix_supercell(s, m), SMALL).collect()
    assert len(large) == len(one) * abs(round(np.linalg.det(np.array(m))))
    for r in large:
        assert np.allclose(r.features, one[r.atom_id % len(one)], rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("hkl", [(1, 1, 1), (1, 0, 0), (0, 0, 1), (0, 0, -2), (2, 1, 0), (3, -2, 4), (0, 2, 4), (-1, 0, 2)])
def test_slabs_lie_on_their_plane(spark, hkl):
    u = np.array(FX.plane_basis(hkl))
    assert round(np.linalg.det(u)) == 1 and (u[:2] @ np.array(hkl) == 0).all() and abs(u[2] @ np.array(hkl)) == np.gcd.reduce(hkl)
    s = FX.structures(spark, ["cu_fcc"])
    r = FX.miller_slab(s, hkl, 3, 12.0).first()
    cell = np.array(r.cell)
    a = 3.615
    normal = np.array(hkl) / np.linalg.norm(hkl)  # of a cube
    assert len(r.charges) == len(r.coords) == 12 and tuple(r.pbc) == (True, True, False)
    assert np.allclose(np.abs(cell[2] @ normal), np.linalg.norm(cell[2])) and np.allclose(cell[:2] @ normal, 0)
    spacing = a * np.gcd.reduce(hkl) / np.linalg.norm(hkl)
    assert np.linalg.norm(cell[2]) == pytest.approx(3 * spacing + 12.0)
    assert abs(np.linalg.det(np.array([cell[0], cell[1], normal]))) * spacing == pytest.approx(a**3)
    with pytest.raises(ValueError, match="index"):
        FX.plane_basis((0, 0, 0))


@pytest.mark.parametrize("by_element", [False, True])
def test_networks_by_plain_loops(spark, by_element):
    rng = np.random.default_rng(4)
    w, rcut = 4, 3.0
    layer = lambda o, i: (rng.normal(size=(o, i)), rng.normal(size=o))
    start = {1: rng.normal(size=w), 6: rng.normal(size=w)} if by_element else layer(w, 2)
    net = N.Network(rcut, start, [[layer(w, w), layer(w, w)] for _ in range(3)], [[layer(w, 2 * w), layer(w, w)] for _ in range(3)], [layer(w, w), layer(1, w)], [layer(w, 1), layer(w, w)] if by_element else None)
    rows = [(s, i, [1, 6, 8][int(rng.integers(0, 3))], *map(float, rng.uniform(0, 3, 3))) for s in range(3) for i in range(4)] + [(7, 0, 6, 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, ATOMS)
    nodes = atoms.selectExpr("structure_id", "atom_id", "z", "array(double(z), x) as features")
    got = {r.structure_id: r.p for r in net.predict(nodes, P.edges(P.molecular_pairs(atoms, rcut))).collect()}
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        x = np.array([r[3:] for r in own])
        h = np.array([start.get(r[2], np.zeros(w)) for r in own]) if by_element else N.dense(np.array([[r[2], r[3]] for r in own], float), [start])
        d = np.linalg.norm(x[:, None] - x, axis=2)
        e = np.where((d > 0) & (d < rcut), 0.5 * (np.cos(np.pi * d / rcut) + 1), 0.0)[:, :, None] * (N.dense(d.reshape(-1, 1), net.distance).reshape(len(x), len(x), w) if by_element else 1.0)
        for m, u in zip(net.messages, net.updates, strict=True):
            sums = (N.dense(h, m)[:, None] * e).sum(0)
            h = h + N.dense(np.hstack([h, sums]), u)
        assert got[s] == pytest.approx(N.dense(h, net.output).sum(), rel=1e-9)
    with pytest.raises(ValueError, match="pairs"):
        N.Network(rcut, start, net.messages, net.updates[:1], net.output)
