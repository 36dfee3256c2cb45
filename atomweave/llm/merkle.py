"""Merkle manifest of a dataset, with authentication paths by Merkle traversal scheduling.

Leaves (one a row, hashed by Spark's sha2) are numbered within their tree by a range sort and counts by partition: no tree, however
large, passes through one task. Neighbouring nodes form runs of ARITY, the last run may be shorter, and a run's digest is a node of the level above.

A tree is worked on in aligned blocks of ARITY ** LEVELS leaves. Within a block the authentication path advances leaf by leaf: the
path holds one run a level, and beside each of them a treehash stack builds the run that comes next on that level. With every leaf that
passes, each stack takes in one leaf further ahead; a run on a level lasts as many leaves as its successor has below it, so the
successor is ready just when it is needed. A traversal holds two runs a level beside the block's leaves, which is
logarithmic in the block, and makes no table of its nodes.

1. Up: each block of leaves gives its root; roots are the leaves of the next layer, LEVELS levels up, until every tree has one
   node left. A layer has ARITY ** LEVELS times fewer rows than the one below. The roots of the trees, in order, are the leaves of one
   more tree, made alike.
2. Down: blocks of the topmost layer give paths to their leaves, which are the roots of the blocks below; so each block of leaves
   meets one row with the shared upper path, and appends it to the paths of its own traversal.
Each block is one group of at most ARITY ** LEVELS rows of about two hundred bytes, so a hot tree is cut like any other.

Defined results: null fields are hashed as '-'; within a tree, a null identifier comes first, and rows of equal identifiers are in the
order of their leaves (equal leaves are interchangeable); a null tree name is a tree of its own, the first; a row without identifier is
never tampered with; texts of any length are hashed whole; an empty table gives an empty result; columns that aren't
fields are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fixed_partitions

ARITY = 16
LEVELS = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPERED = 5

#: One level of a path: where the node stands in its run, and the digests of the whole run (hex).
STEP = "struct<at:int,run:array<string>>"


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """Digest of fields: '-' if null, else the UTF-8 byte count, ':' and the value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tampered(id_: Column) -> Column:
    """Rows that are tampered with: TAMPERED divides the unsigned CRC-32 of the decimal identifier."""
    return F.coalesce(F.crc32(id_.cast("string")) % TAMPERED == 0, F.lit(False))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with pos, their place (from 0) in their tree in the order of the columns, and n, the rows of the tree. A range sort, then counts
    by (partition, tree): no task orders a whole tree."""
    dealt = rows.repartitionByRange(fixed_partitions(rows), tree, *order).withColumn("__part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    own = Window.partitionBy(tree)
    ahead = F.sum("__m").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(tree, "__part").agg(F.count(F.lit(1)).alias("__m"))  # at most as many rows as partitions and trees
    counts = counts.select(tree, "__part", F.coalesce(ahead, F.lit(0)).alias("__ahead"), F.sum("__m").over(own).alias("n"))
    inside = F.row_number().over(Window.partitionBy(tree, "__part").orderBy(*order)) - 1
    return dealt.withColumn("__in", inside).join(counts, [tree, "__part"]).withColumn("pos", F.col("__in") + F.col("__ahead")).drop("__part", "__in", "__ahead")


class Treehash:
    """The nodes of one run on a level, from the leaves below it: a stack a level holds the nodes of the unfinished run there; a full one is
    hashed and its node goes up."""

    def __init__(self, level: int):
        self.stacks: list[list[str]] = [[] for _ in range(level + 1)]

    def push(self, node: str, level: int = 0) -> None:
        self.stacks[level].append(node)
        if level + 1 < len(self.stacks) and len(self.stacks[level]) == ARITY:
            self.close(level)

    def close(self, level: int) -> None:
        run, self.stacks[level] = self.stacks[level], []
        self.push(digest(run), level + 1)

    def finish(self) -> list[str]:
        """The run, with shorter runs below it at the end of the leaves."""
        for level in range(len(self.stacks) - 1):
            if self.stacks[level]:
                self.close(level)
        return self.stacks[-1]


def block_root(leaves: list[str], levels: int) -> str:
    """The node levels above leaves."""
    t = Treehash(levels)
    for x in leaves:
        t.push(x)
    return t.finish()[0]


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf its path in the block, from below: (place in the run, the run) of each level. Runs are shared between paths, not copied."""
    spans = [ARITY ** (level + 1) for level in range(levels)]
    runs, ahead = [], []
    for level, span in enumerate(spans):
        first = Treehash(level)
        for x in leaves[:span]:
            first.push(x)
        runs.append(first.finish())
        ahead.append(Treehash(level))
    for k in range(len(leaves)):
        yield [(k // (span // ARITY) % ARITY, run) for span, run in zip(spans, runs, strict=True)]
        for level, span in enumerate(spans):
            if k + span < len(leaves):
                ahead[level].push(leaves[k + span])
            if (k + 1) % span == 0:
                runs[level], ahead[level] = ahead[level].finish(), Treehash(level)


def height(n: int) -> int:
    """Levels above n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def levels_at(n: int, layer: int) -> int:
    """How many levels of a tree of n leaves a layer makes."""
    return min(LEVELS, max(0, height(n) - layer * LEVELS))


def siblings(path: list[tuple[int, list[str]]]) -> Iterator[str]:
    for at, run in path:
        yield from run[:at]
        yield from run[at + 1 :]


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its path lead to."""
    for at, run in path:
        node = digest([*run[:at], node, *run[at + 1 :]])
    return node


NODES = "tree string, n long, pos long, node string"
PATHS = f"tree string, pos long, subroot string, root string, path array<{STEP}>"
STEP_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))


def block_of_pos() -> Column:
    return F.floor(F.col("pos") / ARITY**LEVELS)


def in_order(t: pa.Table) -> pa.Table:
    return t.sort_by("pos")


def above(nodes: DataFrame, layer: int) -> DataFrame:
    """NODES of a layer -> NODES of the next: the roots of its blocks."""

    def one(t: pa.Table) -> pa.Table:
        t = in_order(t)
        n, pos = t.column("n")[0].as_py(), t.column("pos")[0].as_py()
        root = block_root(t.column("node").to_pylist(), levels_at(n, layer))
        return pa.table({"tree": t.column("tree").slice(0, 1), "n": pa.array([n]), "pos": pa.array([pos // ARITY**LEVELS]), "node": pa.array([root])})

    return nodes.groupBy("tree", block_of_pos().alias("block")).applyInArrow(one, NODES)


def below(nodes: DataFrame, upper: DataFrame, layer: int, make, schema: str) -> DataFrame:
    """make(block's nodes in order, their paths up to the root, the row of PATHS of the block's root) -> a table of the schema, for each block."""

    def one(t: pa.Table, u: pa.Table) -> pa.Table:
        t, top = in_order(t), u.to_pylist()[0]
        shared = [(s["at"], s["run"]) for s in top["path"]]
        own = traverse(t.column("node").to_pylist(), levels_at(t.column("n")[0].as_py(), layer))
        return make(t, ((p, shared) for p in own), top)

    return nodes.groupBy("tree", block_of_pos().alias("block")).cogroup(upper.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(one, schema)


def whole_paths(t: pa.Table, paths, top: dict) -> pa.Table:
    steps = [[{"at": at, "run": run} for at, run in [*p, *shared]] for p, shared in paths]
    n = t.num_rows
    return pa.table({"tree": t.column("tree"), "pos": t.column("pos"), "subroot": pa.array([top["subroot"]] * n, pa.string()), "root": pa.array([top["root"]] * n, pa.string()), "path": pa.array(steps, STEP_ARROW)})


def layers(nodes: DataFrame) -> list[DataFrame]:
    """NODES of all layers, from the leaves to the roots of the trees. The driver sees the size of the largest tree."""
    out = [nodes]
    tall = height(nodes.agg(F.max("n")).first()[0] or 0)
    for layer in range(max(1, -(-tall // LEVELS))):
        out.append(checkpointed(above(out[-1], layer)))
    return out


def root_paths(roots: DataFrame) -> DataFrame:
    """PATHS of the trees' roots (tree, node) in the tree above them: a tree of trees."""
    leaves = numbered(roots.select(F.lit("").alias("all"), F.col("tree").alias("name"), "node"), "all", ["name"])
    leaves = checkpointed(leaves.select(F.col("all").alias("tree"), "n", "pos", "node", "name"))
    steps = layers(leaves.select("tree", "n", "pos", "node"))
    top = steps.pop()
    paths = top.select("tree", "pos", F.col("node").alias("subroot"), F.col("node").alias("root"), F.from_json(F.lit("[]"), f"array<{STEP}>").alias("path"))
    for layer in range(len(steps) - 1, -1, -1):
        paths = checkpointed(below(steps[layer], paths, layer, whole_paths, PATHS))
    found = paths.join(leaves.select("pos", "node", "name"), "pos")
    return found.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "root", "path")


def hashed(df: DataFrame, id_col: str, tree_col: str, fields: list[str], text_col: str) -> DataFrame:
    """(tree, id, leaf, changed): changed is the leaf after tampering, null where there is none. The name of a null tree sorts before all others."""
    own = [F.col(f) for f in fields]
    lowered = [F.translate(c.cast("string"), UPPER, LOWER) if f == text_col else c for f, c in zip(fields, own, strict=True)]
    tree = F.col(tree_col).cast("string")
    name = F.when(tree.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), tree))
    return df.select(name.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf_of(own).alias("leaf"), F.when(tampered(F.col(id_col)), leaf_of(lowered)).alias("changed"))


def _built(df: DataFrame, id_col: str, tree_col: str, fields: list[str], text_col: str, make, schema: str) -> DataFrame:
    leaves = numbered(hashed(df, id_col, tree_col, fields, text_col), "tree", ["id", "leaf"])
    leaves = checkpointed(leaves.withColumnRenamed("leaf", "node"))
    steps = layers(leaves.select("tree", "n", "pos", "node"))
    upper = checkpointed(root_paths(steps.pop()))
    for layer in range(len(steps) - 1, 0, -1):
        upper = checkpointed(below(steps[layer], upper, layer, whole_paths, PATHS))
    return below(leaves, upper, 0, make, schema)


def authentication_paths(df: DataFrame, id_col: str = "doc_id", tree_col: str = "source", fields: list[str] = FIELDS, text_col: str = "text") -> DataFrame:
    """One row per row of df: identifier, leaf, subroot, root and path, from the leaf's run up to the root's: of each level the place in the run, and the run."""

    def make(t: pa.Table, paths, top: dict) -> pa.Table:
        w = whole_paths(t, paths, top)
        return pa.table({"id": t.column("id"), "leaf": t.column("node"), "subroot": w.column("subroot"), "root": w.column("root"), "path": w.column("path")})

    return _built(df, id_col, tree_col, fields, text_col, make, f"id long, leaf string, subroot string, root string, path array<{STEP}>").withColumnRenamed("id", id_col)


def manifest(df: DataFrame, id_col: str = "doc_id", tree_col: str = "source", fields: list[str] = FIELDS, text_col: str = "text") -> DataFrame:
    """One row per row of df: identifier, leaf, subroot, root, proof_sha256 (digest of the siblings from the leaf's run up to the root's), folded_root (the root that
    the leaf, tampered with where tampered() holds, leads to with its siblings), verified (it is the root)."""

    def make(t: pa.Table, paths, top: dict) -> pa.Table:
        proofs, folded, beyond = [], [], None
        for leaf, changed, (path, shared) in zip(t.column("node").to_pylist(), t.column("changed").to_pylist(), paths, strict=True):
            beyond = "".join(siblings(shared)).encode() if beyond is None else beyond
            h = hashlib.sha256("".join(siblings(path)).encode())
            h.update(beyond)
            proofs.append(h.hexdigest())
            folded.append(fold(fold(changed or leaf, path), shared))
        n = t.num_rows
        return pa.table({"id": t.column("id"), "leaf": t.column("node"), "subroot": pa.array([top["subroot"]] * n, pa.string()), "root": pa.array([top["root"]] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == top["root"] for f in folded], pa.bool_())})

    return _built(df, id_col, tree_col, fields, text_col, make, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumnRenamed("id", id_col)
