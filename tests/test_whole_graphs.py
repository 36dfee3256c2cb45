"""Forward passes over whole structures."""

import numpy as np
import pytest
from conftest import SF

from atomweave import entries
from atomweave.operators import models as M
from atomweave.operators import networks as N
from atomweave.sources import derived as D


def graphs(spark, w):
    """Structures of several sizes with gaps in their numbers: some without edges, an atom without any, edges of atoms that don't exist, an edge twice."""
    rng = np.random.default_rng(8)
    atoms = [(s, 3 * i - 2, int(rng.integers(1, 5)), rng.normal(size=w).tolist()) for s in range(12) for i in range(1 + s % 5)]
    edges = [(s, 3 * i - 2, 3 * j - 2, float(rng.uniform(0.5, 3.9))) for s in range(12) if s % 4 for i in range(1 + s % 5) for j in range(s % 5) if i != j]
    edges += [edges[0], (0, 77, -2, 1.0), (7, -2, 77, 1.0), (7, -2, -1, 1.0), (99, 1, 2, 1.0)]
    return spark.createDataFrame(atoms, "structure_id long, atom_id int, z int, features array<double>"), spark.createDataFrame(edges, "structure_id long, src int, tgt int, dist double")


def found(df):
    rows = df.collect()
    assert len(rows) == 12
    return {r.structure_id: pytest.approx(r.p, rel=1e-10, abs=1e-12) for r in rows}


@pytest.mark.parametrize("by_element", [False, True])
def test_networks_of_whole_structures(spark, by_element):
    nodes, edges = graphs(spark, 2)
    network = entries.ELEMENT_NETWORK if by_element else entries.PLAIN_NETWORK
    assert isinstance(network, N.Network)
    want = network.predict(nodes, edges).collect()
    assert {r.structure_id: r.p for r in want} == found(network.predict(nodes, edges, whole=True))


def test_messages_of_whole_structures(spark):
    nodes, edges = graphs(spark, 3)
    nodes = nodes.drop("z")
    want = M.message_network(nodes, edges, 4.0, 2, [1.0, -0.5, 2.0]).collect()
    assert {r.structure_id: r.p for r in want} == found(M.message_network(nodes, edges, 4.0, 2, [1.0, -0.5, 2.0], whole=True))


@pytest.mark.parametrize("name", ["weighted_network", "element_network", "message_network"])
def test_layers_shuffle_nothing(spark, monkeypatch, name):
    """each layer dealt nodes and edges anew by structure and atom."""
    monkeypatch.setattr(D, "DEALT", 100)
    plan = entries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(structure_id" not in plan and "REPARTITION_BY_NUM" in plan and "Scan ExistingRDD" not in plan.replace("Scan ExistingRDD[z", "")
