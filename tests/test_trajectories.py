"""Neighbours of trajectories against a search of every frame."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators import pairs as P
from atomweave.operators import trajectories as TR
from atomweave.schema import STRUCTURES
from atomweave.sources import files

KEY = ["structure_id", "frame", "i", "j", "nx", "ny", "nz"]


def frames_of(spark, rows):
    schema = STRUCTURES.simpleString()[len("struct<"):-1]
    return spark.createDataFrame(rows, f"{schema},frame:int")


def by_frame(frames, rcut):
    """A search of every frame, as a structure of its own."""
    out = P.periodic_pairs(frames.withColumn("structure_id", F.struct("structure_id", "frame")), rcut)
    return {(r.structure_id.structure_id, r.structure_id.frame, r.i, r.j, r.nx, r.ny, r.nz): r.r for r in out.collect()}


def walk(seed, n, atoms, step, pbc=True):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 5, (atoms, 3))
    cell = [[5.0, 0.0, 0.0], [1.0, 5.0, 0.0], [0.5, 0.7, 5.0]]
    z = [float(q) for q in rng.integers(1, 9, atoms)]
    out = []
    for t in range(n):
        out.append([seed, z, x.tolist(), cell, (pbc,) * 3, None, t])
        x = x + rng.normal(0, step, x.shape)
    return out


@pytest.mark.parametrize("block, skin", [(1, 0.5), (7, 0.0), (7, 1.0), (64, 0.6)])
def test_pairs_of_frames_are_those_of_a_search_of_each(spark, block, skin):
    rows = walk(1, 20, 5, 0.05) + walk(2, 9, 4, 0.4) + walk(3, 12, 3, 0.03, False)
    rows += [[4, [6.0, 6.0], [[0.0] * 3, [0.3 * t, 0.0, 0.0]], rows[0][3], (True,) * 3, None, 10 * t] for t in range(4)]  # two atoms that part from one place
    rows[5][3] = [[5.5, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 5.0]]  # another cell
    rows[8][1] = [1.0, 1.0, 8.0, 8.0, 8.0]  # other elements
    rows[12][1], rows[12][2] = rows[12][1][:3], rows[12][2][:3]  # fewer atoms
    rows[14][1], rows[14][2] = [], []
    frames = frames_of(spark, rows)
    want = by_frame(frames, 2.5)
    got = TR.trajectory_pairs(frames.withColumn("extra", F.lit(1)).repartition(5), 2.5, skin, block).collect()
    assert len(got) == len(want) > 100
    assert {tuple(r[c] for c in KEY) for r in got} == set(want)
    assert all(r.r == pytest.approx(want[tuple(r[c] for c in KEY)], abs=1e-12) for r in got)


def test_references_last_until_an_atom_has_moved_by_half_the_skin(spark):
    cell = [[9.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0]]
    rows = [[1, [1.0, 1.0], [[0.0] * 3, [1.0, 0.2 * t, 0.0]], cell, (True,) * 3, None, t] for t in range(10)]
    got = {r.frame: r.reference for r in TR.references(frames_of(spark, rows), 0.9, 8).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 8, 9: 8}


def test_work_is_less_than_searches_of_all_frames(spark):
    frames = frames_of(spark, walk(5, 30, 6, 0.01))
    r = TR.trajectory_work(frames, 2.5, 1.0, 30).first()
    assert (r.structure_id, r.n_frames) == (5, 30) and r.n_references <= 3
    images = P.images(frames.withColumn("structure_id", F.struct("structure_id", "frame")), 2.5).count()
    assert len(by_frame(frames, 2.5)) <= r.measured < images * 36 / 3  # a search of each frame measures atoms x atoms x images


def test_frames_of_a_molecule_without_a_cell(spark):
    rows = spark.createDataFrame([(t, 0.5, [[0.0, 0.0, 0.0], [1.0 + 0.1 * t, 0.0, 0.0]], [6, 1]) for t in range(3)], "frame bigint, E double, R array<array<double>>, z array<int>")
    got = TR.trajectory_pairs(files.trajectory_frames(rows, 7), 3.0, 0.5).collect()
    assert sorted((r.structure_id, r.frame, r.i, r.j, round(r.dx, 6)) for r in got) == sorted((7, t, i, 1 - i, round((1 + 0.1 * t) * (1 - 2 * i), 6)) for t in range(3) for i in range(2))


def test_empty_and_null_frames(spark):
    empty = frames_of(spark, [])
    assert TR.trajectory_pairs(empty, 3.0).count() == 0 and TR.trajectory_work(empty, 3.0).count() == 0
    cell = [[5.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 5.0]]
    rows = [[1, None, None, cell, (True,) * 3, None, 0], [1, [1.0], [[0.0] * 3], cell, (True,) * 3, None, 1]]
    assert {r.frame for r in TR.trajectory_pairs(frames_of(spark, rows), 5.5).collect()} == {1}
    with pytest.raises(ValueError, match="block"):
        TR.references(empty, 1.0, 0)
