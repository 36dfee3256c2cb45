"""Findings of round 3 on what queries take on larger tables: plans and partitions."""

from conftest import SF

from atomweave import entries
from atomweave.sources import derived as D


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_are_measured_behind_their_join(spark):
    """as a condition of the join, the distance had its coordinates written out again and again."""
    plan = plan_of(entries.trajectory_neighbors(spark, SF))
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "coords#" in line]
    assert not any("SQRT" in line for line in joins)


def test_tasks_are_dealt_a_number_of_atoms(spark, monkeypatch):
    """with a fixed number of parts, a task's memory grew with the table."""
    monkeypatch.setattr(D, "DEALT", 100)
    n = D.table(spark, SF, "lineitem").count()
    a = D.atoms(spark, SF)
    sizes = [len(p) for p in a.select("structure_id").rdd.glom().collect()]
    assert sum(sizes) == n and len(sizes) == -(-n // 100) and max(sizes) < 300
    plan = plan_of(entries.two_body_sum(spark, SF))
    assert plan.count("Exchange hashpartitioning(structure_id") == 0 and "REPARTITION_BY_NUM" in plan


def test_features_of_molecules_shuffle_atoms_only(spark, monkeypatch):
    """blocks of features were dealt anew by atom, and their channels by structure and channel."""
    monkeypatch.setattr(D, "DEALT", 100)
    plan = plan_of(entries.molecular_features(spark, SF))
    assert "Exchange hashpartitioning(structure_id" not in plan and "REPARTITION_BY_NUM" in plan


def test_legacy_features_shuffle_atoms_only(spark, monkeypatch):
    """its blocks were dealt anew by atom."""
    monkeypatch.setattr(D, "DEALT", 100)
    plan = plan_of(entries.legacy_features(spark, SF))
    assert "Exchange hashpartitioning(structure_id" not in plan and "REPARTITION_BY_NUM" in plan
