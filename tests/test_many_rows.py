"""Findings of round 3 on queries whose rows are many: what is done to each."""

import numpy as np
import pytest
from conftest import SF

from atomweave import entries
from atomweave.operators import kernels as K
from atomweave.operators import pooling as L
from atomweave.plans import features as PF
from atomweave.sources import derived as D


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_slots_are_made_of_rounded_values(spark):
    """F16: every slot, most of them zeros, was rounded, and bags were arrays of all elements."""
    plan = plan_of(entries.bag_sort(spark, SF))
    assert "round(" in plan and plan.index("Generate explode") < plan.index("round(")
    rows = spark.createDataFrame([(1, 6, 0, 2.0), (1, 6, 0, 5.0), (1, 8, 0, None), (2, 6, 0, -1.0), (2, 7, 0, 3.0)], "structure_id long, z int, channel int, value double")
    sizes = spark.createDataFrame([(6, 3), (7, 0), (8, 2)], "z int, size int")
    got = {(r.structure_id, r.z, r.slot): r.value for r in L.bag(rows, sizes).collect()}
    assert got == {(1, 6, 1): 5.0, (1, 6, 2): 2.0, (1, 6, 3): 0.0, (1, 8, 1): None, (1, 8, 2): 0.0, (2, 6, 1): -1.0, (2, 6, 2): 0.0, (2, 6, 3): 0.0, (2, 7, 1): 3.0, (2, 8, 1): 0.0, (2, 8, 2): 0.0}


def test_groups_of_rows_and_marks_meet_in_many_tasks(spark, monkeypatch):
    """groups met by the marks' group alone, so a set of few groups of marks was the work of few tasks; and each kernel was rounded as a decimal."""
    assert " round(" not in plan_of(entries.laplacian_kernel(spark, SF))
    monkeypatch.setattr(K, "MAX_LANDMARKS", 3)
    rows = spark.createDataFrame([(i, [i / 7.0, 1.0 - i / 5.0]) for i in range(40)], "id long, features array<double>")
    df = K.rectangular(rows, rows.filter("id % 5 = 0"), "laplacian", 0.3)
    join = next(line for line in plan_of(df).splitlines() if "Join" in line)
    assert "[a#" in join and ", b#" in join
    got = {(r.a_id, r.b_id): r.k for r in df.collect()}
    assert len(got) == 40 * 8
    assert all(k == pytest.approx(np.exp(-0.3 * abs(a - b) * (1 / 7 + 1 / 5))) for (a, b), k in got.items())


def test_rounded_values(spark):
    x = [0.0, -0.0, 1.0, -1.0, 4e-7, -4e-7, 6e-7, -6e-7, 0.1234564, 0.1234567, -0.1234567, None, *np.random.default_rng(1).uniform(-1, 1, 5000).tolist()]
    df = spark.createDataFrame([(v,) for v in x], "v double").select(entries.rounded("v").alias("a"), entries.R("v").alias("b"))
    assert all(r.a == r.b and str(r.a) == str(r.b) for r in df.collect())


def test_sweeps_are_pooled_as_histograms(spark):
    """every atom and setting had features, which were dealt anew by atom and exploded by channel to be summed."""
    s = D.crystals(spark, SF).limit(3).persist()
    settings = [*entries.SWEPT[::3], PF.Parameters(rcut=4.5, order=0, max_body=2, step=0.1, lookup="round")]
    want = {}
    for r in PF.swept_features(s, settings).collect():
        want[r.setting, r.structure_id] = want.get((r.setting, r.structure_id), 0.0) + np.array(r.features)
    got = {(r.setting, r.structure_id): r.features for r in PF.swept_features(s, settings, pooled=True).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * len(settings)
    assert all(got[k] == pytest.approx(want[k].tolist(), rel=1e-9, abs=1e-9) for k in got)
    s.unpersist()
    assert "hashpartitioning(structure_id#" in plan_of(entries.feature_sweep(spark, SF)) and ", i#" not in "".join(line for line in plan_of(entries.feature_sweep(spark, SF)).splitlines() if "hashpartitioning" in line)
