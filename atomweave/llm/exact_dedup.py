"""Exact deduplication by a tree merge of sorted digest runs.

Level 0: every scan partition sorts its rows by digest and merges neighbours, which makes a sorted run of distinct digests, each
with the identifier that stays and a count. Then binomial rounds: in a round the runs whose numbers differ in the lowest
three bits exchange their rows with the one whose bits are 0 (three steps of a binomial tree at once), where they are merged.
Runs travel as packs: one row is a sorted stretch of a run, so they arrive sorted, and a task merges the packs of its up to eight runs two by two in
order of digest (each place found by binary search in the other pack, nothing is sorted again). A run that covers 8^k partitions is cut by the leading
bits of the digest into 8^k slices, so a task of any round gets as many rows as one partition had, and a digest at most eight times. Rounds end
with one run.

Every merge verifies: rows become one only if the 64-bit hash that leads the order, the byte length and SHA-256 all agree.
A text that a third of all rows share is one row of each run after level 0. Where rows learn their group, the few texts of
very many rows are broadcast and their rows stay where they are (common.told); the others meet by digest.

Defined results: null text counts as empty; a null identifier loses against any other; of repeated rows with equal
identifier and text exactly one is kept; texts of any length are hashed whole; an empty table gives an empty result; other
columns are never read, and none that drop_exact returns can clash with the names used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, checkpointed, inner, located, only, text_of, told

BITS = 3
KEY = ["__hash", "__bytes", "__sha"]


def digests(text: Column) -> list[Column]:
    """Columns of the verified digest of a text, in the order in which runs are sorted."""
    t = text_of(text)
    return [F.xxhash64(t).alias("__hash"), F.octet_length(t).cast("long").alias("__bytes"), F.sha2(t, 256).alias("__sha")]


PACKS = "__run int, __slice int, pack binary"


def packed(t: pa.Table, run: int, level: int) -> Iterator[tuple[int, int, bytes]]:
    """A sorted table as packs (run, slice, bytes), cut where the leading bits for the level change."""
    h = t.column("__hash").to_numpy()
    part = slice_of(h, level)
    at = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), t.num_rows] if t.num_rows else []
    for a, b in zip(at, at[1:], strict=False):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema) as w:
            w.write_table(t.slice(a, b - a).combine_chunks())
        yield run, int(part[a]), out.getvalue().to_pybytes()


def unpacked(pack) -> pa.Table:
    with pa.ipc.open_stream(pack) as r:
        return r.read_all()


def slice_of(h: np.ndarray, level: int) -> np.ndarray:
    """The leading BITS * level bits of hashes."""
    return (h.view(np.uint64) >> np.uint64(64 - BITS * min(level, 8))).astype(np.int64) if level else np.zeros(len(h), np.int64)


def merged_two(a: pa.Table, b: pa.Table) -> pa.Table:
    """Two sorted tables as one, in order of the hash."""
    x, y = a.column("__hash").to_numpy(), b.column("__hash").to_numpy()
    order = np.empty(len(x) + len(y), np.int64)
    order[np.searchsorted(y, x, side="left") + np.arange(len(x))] = np.arange(len(x))
    order[np.searchsorted(x, y, side="right") + np.arange(len(y))] = np.arange(len(x), len(x) + len(y))
    return pa.concat_tables([a, b]).take(pa.array(order))


def equal_to_last(t: pa.Table) -> np.ndarray:
    """Whether each row but the first has the verified digest of the row before: hash, length and SHA-256."""
    same = np.ones(max(t.num_rows - 1, 0), bool)
    for name in KEY:
        c = t.column(name).combine_chunks()
        same &= pc.equal(c.slice(1), c.slice(0, len(same))).to_numpy(zero_copy_only=False)
    return same


def combined(t: pa.Table, keep: str) -> pa.Table:
    """Rows in order of hash -> one row of each digest, the one that stays, with the sum of __n."""
    h = t.column("__hash").to_numpy()
    same = equal_to_last(t)
    if ((h[1:] == h[:-1]) & ~same).any():  # a hash with several texts: these must stand together
        t = t.take(pc.sort_indices(t, [(c, "ascending") for c in KEY]))
        same = equal_to_last(t)
    if not same.any():
        return t
    group = np.cumsum(np.r_[True, ~same])
    own = t.append_column("__group", pa.array(group))
    more = [c for c in t.column_names if c not in (*KEY, "__id", "__n")]
    order = pc.sort_indices(own.select(["__group", "__id", *more]), [("__group", "ascending"), ("__id", "descending" if keep == "max" else "ascending"), *((c, "ascending") for c in more)], null_placement="at_end")
    start = np.flatnonzero(np.r_[True, ~same])
    n = np.add.reduceat(t.column("__n").to_numpy(), start)
    k = t.schema.get_field_index("__n")
    return t.take(order.take(pa.array(start))).set_column(k, t.schema.field(k), pa.array(n, pa.int64()))


def merged(tables: list[pa.Table], keep: str) -> pa.Table:
    """Sorted tables as one of distinct digests: neighbours in a queue are merged until one is left, the shortest first."""
    tables = sorted(tables, key=lambda t: t.num_rows)
    while len(tables) > 1:
        pairs = [combined(merged_two(a, b), keep) for a, b in zip(tables[::2], tables[1::2], strict=False)]
        tables = pairs + tables[len(pairs) * 2 :]
    return tables[0]


def merge_runs(rows: DataFrame, keep: str = "max") -> DataFrame:
    """rows (__id, ..., KEY) -> one row per distinct text, sorted by slices: KEY, __id and the columns between (those of the row that stays) and __n (rows).
    Of equal identifiers the row that comes first in the order of the other columns stays."""
    more = [c for c in rows.columns if c not in ("__id", *KEY)]
    plain = rows.select(*KEY, "__id", *more, F.lit(1).cast("long").alias("__n"))
    kinds = (pa.int32(), pa.int32(), pa.binary())

    def batch(packs: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in packs], t) for i, t in enumerate(kinds)], names=["__run", "__slice", "pack"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        for b in batches:  # sorted: a stretch of the run
            if b.num_rows:
                yield batch(list(packed(combined(pa.Table.from_batches([b]), keep), run, 1)))

    def one(level: int):
        def merge(t: pa.Table) -> pa.Table:
            done = merged([unpacked(p.as_buffer()) for p in t.column("pack")], keep)
            return pa.Table.from_batches([batch(list(packed(done, t.column("__run")[0].as_py() >> BITS, level + 1)))])

        return merge

    width = (rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    runs, level = plain.sortWithinPartitions(*KEY).mapInArrow(first, PACKS), 0
    while width > 1 or not level:  # the only run's stretches are merged too
        level, width = level + 1, -(-width >> BITS)
        runs = runs.groupBy(F.shiftright("__run", BITS).alias("r"), "__slice").applyInArrow(one(level), PACKS)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("pack"):
                yield from unpacked(p.as_buffer()).to_batches()

    return runs.mapInArrow(rows_of, plain.schema)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per input row: identifier, keep_id, group_size, kept, text_sha256."""
    rows = checkpointed(df.select(F.col(id_col).alias("__id"), *digests(F.col(text_col))))
    merged = checkpointed(merge_runs(rows, keep).select(*KEY, F.col("__id").alias("__keep"), "__n"))
    own = rows.groupBy("__id", *KEY).agg(F.count(F.lit(1)).alias("__m"))  # repeated rows as one
    out = told(own, merged, KEY, hot_rows)
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m"))))
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        (F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__copy") == 1)).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of df that stay, with all their columns; of repeated rows the first read."""
    rows = located(df)
    light = checkpointed(rows.select(inner(id_col).alias("__id"), "__at", *digests(inner(text_col))))
    return only(rows, merge_runs(light, keep))
