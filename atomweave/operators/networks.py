"""Forward passes of message networks with weights.

Nodes go through dense layers in Arrow blocks (one matrix product a block); the weights are parameters of fixed size and travel with the task. A message
is made at its source, so an edge only joins it and scales it by its distance; messages are summed by target as columns of one aggregate. Edges, which
neighbours bound, are the only table that a layer shuffles beside the nodes; nodes are checkpointed after each layer, as the next one reads
them twice. Where structures are many and small, all layers pass over the atoms and edges of whole structures instead, and nothing is shuffled but what makes them. Training isn't part of this library: weights come from outside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import checkpointed
from .kernels import vectors
from .models import graph_pool, over_graphs, received

#: (weights: out x in, bias) of a dense layer.
Dense = tuple[np.ndarray, np.ndarray]


def silu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + np.tanh(0.5 * x))  # x times the logistic function, without overflow


def dense(x: np.ndarray, layers: list[Dense]) -> np.ndarray:
    """Dense layers with x * sigmoid(x) between them."""
    for k, (w, b) in enumerate(layers):
        x = (silu(x) if k else x) @ w.T + b
    return x


@dataclass
class Network:
    """start: a dense layer on features, or the vector of each element ({z: vector}; an element without one starts at 0). messages and updates: two dense
    layers each, a pair a step; an update reads a node beside the sum of its messages, and is added to the node. distance: dense layers
    from a distance to a factor of each channel, or None. output: dense layers to one number."""

    rcut: float
    start: Dense | dict[int, np.ndarray]
    messages: list[list[Dense]]
    updates: list[list[Dense]]
    output: list[Dense]
    distance: list[Dense] | None = None
    width: int = field(init=False)

    def __post_init__(self):
        self.width = len(self.output[0][0][0])
        if len(self.messages) != len(self.updates) or any(len(u[0][0][0]) != 2 * self.width for u in self.updates):
            raise ValueError("messages and updates come in pairs; an update reads two vectors of the network's width")

    def begun(self, nodes: DataFrame) -> DataFrame:
        """(structure_id, atom_id, h) of nodes (structure_id, atom_id, z, features)."""
        if isinstance(self.start, dict):
            table = nodes.sparkSession.createDataFrame([(int(z), [float(x) for x in v]) for z, v in self.start.items()], "z int, h array<double>")  # a row an element
            zero = F.array_repeat(F.lit(0.0), self.width)
            return nodes.select("structure_id", "atom_id", F.col("z").cast("int").alias("z")).join(F.broadcast(table), "z", "left").select("structure_id", "atom_id", F.coalesce("h", zero).alias("h"))
        return through(nodes.select("structure_id", "atom_id", "features"), ["features"], "h", lambda x: dense(x, [self.start])).select("structure_id", "atom_id", "h")

    def weighed(self, edges: DataFrame) -> DataFrame:
        """edges with the factor of each channel as an array e, or of all channels as a number e."""
        cut = S.cutoff(F.col("dist"), self.rcut)
        if self.distance is None:
            return edges.select("structure_id", "src", "tgt", cut.alias("e"))
        far = edges.select("structure_id", "src", "tgt", "dist", F.array("dist").alias("d"))
        return through(far, ["d"], "f", lambda x: dense(x, self.distance)).select("structure_id", "src", "tgt", F.transform("f", lambda v: v * cut).alias("e"))

    def forward(self, x: np.ndarray, src: np.ndarray, tgt: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """The prediction of each atom, as over_graphs calls it; x: features, or vectors of elements."""
        h = x if isinstance(self.start, dict) else dense(x, [self.start])
        e = 0.5 * (np.cos(np.pi * dist / self.rcut) + 1.0)[:, None]
        e = e if self.distance is None else e * dense(dist[:, None], self.distance)
        for message, update in zip(self.messages, self.updates, strict=True):
            h = h + dense(np.hstack([h, received(dense(h, message)[src] * e, tgt, len(h))]), update)
        return dense(h, self.output)[:, 0]

    def predict(self, nodes: DataFrame, edges: DataFrame, whole: bool = False) -> DataFrame:
        """(structure_id, p): the sum of atom predictions; edges (structure_id, src, tgt, dist). whole: as over_graphs, for many structures whose atoms and edges each fit
        a row; without it, structures have any size."""
        if whole:
            first = self.begun(nodes).withColumnRenamed("h", "features") if isinstance(self.start, dict) else nodes.select("structure_id", "atom_id", "features")
            return over_graphs(first, edges, self.forward)
        now, near = checkpointed(self.begun(nodes)), checkpointed(self.weighed(edges))
        each: list[Column] = [F.col("e")] * self.width if self.distance is None else [F.get("e", F.lit(k)) for k in range(self.width)]
        for message, update in zip(self.messages, self.updates, strict=True):
            sent = through(now, ["h"], "m", lambda x, m=message: dense(x, m)).select("structure_id", F.col("atom_id").alias("src"), "m")
            sums = near.join(sent, ["structure_id", "src"]).groupBy("structure_id", F.col("tgt").alias("atom_id")).agg(*[F.sum(F.get("m", F.lit(k)) * each[k]).alias(f"s{k}") for k in range(self.width)])
            sums = sums.select("structure_id", "atom_id", F.array(*[f"s{k}" for k in range(self.width)]).alias("s"))
            both = now.join(sums, ["structure_id", "atom_id"], "left").withColumn("s", F.coalesce("s", F.array_repeat(F.lit(0.0), self.width)))
            now = checkpointed(through(both, ["h", "s"], "h", lambda x, u=update: x[:, : self.width] + dense(x, u)).select("structure_id", "atom_id", "h"))
        last = through(now, ["h"], "p", lambda x: dense(x, self.output))
        return graph_pool(last.select("structure_id", F.get("p", F.lit(0)).alias("p")))


def through(rows: DataFrame, columns: list[str], name: str, make) -> DataFrame:
    """rows with name = make(the columns side by side), an array a row."""
    kept = [c for c in rows.columns if c != name]
    rows = rows.select(*kept, *[F.col(c).cast("array<double>").alias(f"__{k}") for k, c in enumerate(columns)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)]) + f", `{name}` array<double>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                out = make(np.hstack([vectors(batch.column(len(kept) + k), n) for k in range(len(columns))]))
                ends = pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(out).ravel()))], names=[*kept, name])

    return rows.mapInArrow(each, schema)
