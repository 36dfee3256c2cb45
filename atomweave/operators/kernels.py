"""Kernels between structures and between their atoms.

One side of a rectangular kernel is a set of queries or landmarks. It is cut into blocks of at most MAX_LANDMARKS, the other side streams
past each block, and no pair is shuffled; so a set of any size works, at the cost of one pass over the rows a block.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

MAX_LANDMARKS = 2000
#: The most rows of a group of a set that meets itself.
MOST_OF_GROUP = 1 << 14
#: Groups of rows that marks are sent to, as long as these have at most MOST_OF_GROUP rows.
MOST_COPIES = 64
#: Pairs of a set with itself that are sorted together, and rows of a batch of them.
SORTED, ROWS = 1 << 22, 1 << 19
#: Structures, or rows, of a side of a tile.
MATCH_GROUP, MOST_MATCH_GROUP, TILE_GROUP = 32, 256, 2048
TILES = "a int, b int, n_groups int, ids_a binary, ids_b binary, k binary"


#: Numbers of a block of distances, which stays in a core's cache over all channels.
CACHED = 1 << 15


def l1_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of rows of a and rows of b, in blocks of CACHED numbers at most."""
    out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    wide = max(1, min(len(b), CACHED))
    tall = max(1, CACHED // wide)
    gap = np.empty((tall, wide))
    for at in range(0, len(a), tall):
        x = np.ascontiguousarray(a[at : at + tall].T)
        for to in range(0, len(b), wide):
            block = out[at : at + tall, to : to + wide]
            own = gap[: block.shape[0], : block.shape[1]]
            for u, v in zip(x, columns, strict=True):
                np.subtract(u[:, None], v[to : to + wide], out=own)
                np.abs(own, out=own)
                block += own
    return out


def matrix(a: np.ndarray, b: np.ndarray, kind: str, gamma: float, degree: int = 2) -> np.ndarray:
    if kind == "laplacian":
        return np.exp(-gamma * l1_matrix(a, b))
    if kind == "rbf":
        return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))
    if kind == "polynomial":
        return (gamma * a @ b.T + 1) ** degree
    if kind == "linear":
        return a @ b.T
    raise ValueError(kind)


def landmarks(rows: DataFrame, most: int = MAX_LANDMARKS) -> tuple[list, np.ndarray]:
    """Identifiers and vectors of a set that must not exceed its bound."""
    got = rows.select("id", "features").orderBy("id").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} landmarks")
    return [r.id for r in got], np.array([r.features for r in got])


def checked(marks: DataFrame, most: int = MAX_LANDMARKS) -> DataFrame:
    """marks to broadcast; an error if there are more than most."""
    if marks.select(F.lit(1)).limit(most + 1).count() > most:
        raise ValueError(f"more than {most} landmarks")
    return F.broadcast(marks)


def in_blocks(marks: DataFrame, key: str, one: Callable[[DataFrame], DataFrame], most: int = MAX_LANDMARKS) -> DataFrame:
    """The union of one(block) over blocks of marks by a hash of key: one block up to most rows, else so many that each has about half of most."""
    n = marks.count()
    if n <= most:
        return one(marks)
    blocks = -(-2 * n // most)
    out = None
    for k in range(blocks):
        part = one(marks.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == k))
        out = part if out is None else out.unionByName(part)
    return out


def group_of(id_col: str, n_groups: int) -> Column:
    """The group of an identifier among n_groups."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n_groups)).cast("int")


def tiles_of(groups: DataFrame, n_groups: int, columns: list[str]) -> DataFrame:
    """(a, b, columns of a with suffix a, of b with suffix b) for a <= b: each group goes to the tiles that have it, and the two sides meet by equality. Neither side is
    broadcast: Spark knows the size of the groups, not that of their copies, which would all pass through the driver."""
    left = groups.select(F.col("grp").alias("a"), F.explode(F.sequence("grp", F.lit(n_groups - 1))).alias("b"), *[F.col(c).alias(f"{c}a") for c in columns])
    right = groups.select(F.explode(F.sequence(F.lit(0), "grp")).alias("a"), F.col("grp").alias("b"), *[F.col(c).alias(f"{c}b") for c in columns])
    return left.join(right.hint("merge"), ["a", "b"])


def vectors(column: pa.Array, n: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(n, -1) if n else np.zeros((0, 0))


def vector_groups(rows: DataFrame, n_groups: int) -> DataFrame:
    """(grp, ids, x): rows (id, features) gathered in groups by identifier, as longs and doubles."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = vectors(t.column("features"), t.num_rows)
        return pa.table({"grp": t.column("grp").slice(0, 1), "ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary())})

    own = rows.select(group_of("id", n_groups).alias("grp"), F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    return own.groupBy("grp").applyInArrow(one, "grp int, ids binary, x binary")


def pairs_of(a_ids: np.ndarray, b_ids: np.ndarray, *k: np.ndarray, names: tuple[str, ...] = ("k",)) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(a_ids, len(b_ids))), pa.array(np.tile(b_ids, len(a_ids))), *[pa.array(x.ravel()) for x in k]], names=["a_id", "b_id", *names])


PAIRS = "a_id long, b_id long, k double"


def rectangular(rows: DataFrame, marks: DataFrame, kind: str = "laplacian", gamma: float = 0.05, degree: int = 2) -> DataFrame:
    """(a_id, b_id, k) of every row (id, features) and every mark, in Arrow blocks. Up to MAX_LANDMARKS marks are broadcast and rows stream past them; more are
    gathered in groups, as the rows are, and each group of rows meets each group of marks."""
    return rectangulars(rows, marks, {"k": (kind, gamma, degree)})


def rectangulars(rows: DataFrame, marks: DataFrame, kernels: dict[str, tuple[str, float, int]]) -> DataFrame:
    """As rectangular, with a column for each of several kernels (kind, gamma, degree) by name: pairs are made once, so no kernels are joined."""
    n, names = marks.count(), tuple(kernels)
    schema = ", ".join(["a_id long", "b_id long", *[f"{c} double" for c in names]])

    def block(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pairs_of(a_ids, b_ids, *[matrix(a, b, *k) for k in kernels.values()], names=names)

    if n <= MAX_LANDMARKS:
        ids, x = landmarks(marks)
        shared = rows.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), x))

        def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b_ids, b = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows if len(b_ids) else 0, 512):
                    part = batch.slice(at, 512)
                    yield block(part.column(0).to_numpy(), vectors(part.column(1), part.num_rows), b_ids, b)

        return rows.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(past, schema)
    n_all, n_marks = rows.count(), -(-n // MAX_LANDMARKS)
    n_rows = max(1, -(-n_all // max(MAX_LANDMARKS, min(MOST_OF_GROUP, n_all // MOST_COPIES))))  # marks are sent once for each group of rows
    # dealt by both groups: by the marks' alone there would be as few tasks as groups of marks
    left = vector_groups(rows, n_rows).select(F.col("grp").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_marks - 1))).alias("b"), F.col("ids").alias("idsa"), F.col("x").alias("xa"))
    right = vector_groups(marks, n_marks).select(F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("a"), F.col("grp").alias("b"), F.col("ids").alias("idsb"), F.col("x").alias("xb"))
    met = left.join(right.hint("merge"), ["a", "b"])  # not broadcast: the marks' copies would all pass through the driver

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _sides(batches):
            for at in range(0, len(r["idsa"]), 256):
                yield block(r["idsa"][at : at + 256], r["xa"][at : at + 256], r["idsb"], r["xb"])

    return met.mapInArrow(each, schema)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of two groups with their identifiers and matrices."""
    for batch in batches:
        for r in batch.to_pylist():
            for s in "ab":
                r[f"ids{s}"] = np.frombuffer(r[f"ids{s}"], np.int64)
                r[f"x{s}"] = np.frombuffer(r[f"x{s}"], float).reshape(len(r[f"ids{s}"]), -1)
            yield r


def _blocks(r: dict, kind: str, gamma: float, degree: int, mirrored: bool) -> Iterator[pa.RecordBatch]:
    """Pairs in the order of their kernel: equal (rounded) values stand together, so columnar files hold them as runs and not as a number a pair."""
    a, b = r["idsa"], r["idsb"]
    tall = max(1, SORTED // max(1, len(b)))
    for at in range(0, len(a), tall):
        k = matrix(r["xa"][at : at + tall], r["xb"], kind, gamma, degree).ravel()
        order = np.argsort(k)
        for to in range(0, len(order), ROWS):
            own = order[to : to + ROWS]
            i, j, v = pa.array(a[at + own // len(b)]), pa.array(b[own % len(b)]), pa.array(k[own])
            yield pa.RecordBatch.from_arrays([i, j, v], names=["a_id", "b_id", "k"])
            if mirrored:
                yield pa.RecordBatch.from_arrays([j, i, v], names=["a_id", "b_id", "k"])


def symmetric(rows: DataFrame, gamma: float = 0.05) -> DataFrame:
    """The kernel of a set with itself, identifiers distinct: blocks between groups a <= b are computed, the others mirrored. A group is sent once for each other, so
    large sets have larger groups, up to MOST_OF_GROUP rows."""
    n = rows.count()
    n_groups = max(1, -(-n // max(MAX_LANDMARKS, min(MOST_OF_GROUP, n // 16))))
    met = tiles_of(vector_groups(rows, n_groups), n_groups, ["ids", "x"])
    return met.mapInArrow(lambda batches: (p for r in _sides(batches) for p in _blocks(r, "laplacian", gamma, 2, r["a"] != r["b"])), PAIRS)


def packed(atoms: DataFrame) -> DataFrame:
    """(structure_id, charges, atoms, numbers): atoms (structure_id, atom_id, z, features) as one row a structure, in atom order, with their numbers. Structures
    (structure_id, charges, atoms) are packed already; their atoms are numbered from 0."""
    if "charges" in atoms.columns:
        numbers = F.transform("charges", lambda _, i: i)
        return atoms.select("structure_id", F.col("charges").cast("array<double>").alias("charges"), F.col("atoms").cast("array<array<double>>").alias("atoms"), numbers.alias("numbers"))
    g = atoms.groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("atom_id", F.col("z").cast("double").alias("z"), "features"))).alias("a"))
    return g.select("structure_id", F.transform("a", lambda x: x["z"]).alias("charges"), F.transform("a", lambda x: x["features"]).alias("atoms"), F.transform("a", lambda x: x["atom_id"]).alias("numbers"))


class Marks:
    """Landmark structures as flat arrays: their atoms one after another."""

    def __init__(self, rows: list):
        """rows: packed structures, as dictionaries."""
        rows = [r for r in rows if r["charges"]]
        self.ids = np.array([r["structure_id"] for r in rows], np.int64)
        sizes = np.array([len(r["charges"]) for r in rows], np.int64)
        self.sizes, self.start = sizes, np.cumsum(sizes) - sizes
        self.which = np.repeat(np.arange(len(rows)), sizes)
        self.z = np.array([z for r in rows for z in r["charges"]])
        self.numbers = np.array([n for r in rows for n in r["numbers"]], np.int64)
        self.x = np.array([v for r in rows for v in r["atoms"]], float)

    def own(self, i: int) -> slice:
        return slice(self.start[i], self.start[i + 1] if i + 1 < len(self.start) else len(self.z))

    def between(self, i: int, other: Marks, j: int, sigma: float) -> tuple[np.ndarray, np.ndarray, float]:
        """(same, kernel of atoms, 0) of structure i with structure j of another set, as np.where takes them."""
        a, b = self.own(i), other.own(j)
        return self.z[a][:, None] == other.z[b], np.exp(-l1_matrix(self.x[a], other.x[b]) / sigma), 0.0

    def alike(self, charges, atoms, sigma: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """(same, c): whether an atom of a structure and one of a landmark are of one element, and their kernel."""
        x = np.array(atoms, float).reshape(len(charges), -1)
        far = l1_matrix(x, self.x) if metric == "l1" else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.x * self.x).sum(1) - 2 * x @ self.x.T, 0))
        return np.array(charges)[:, None] == self.z, np.exp(-far / sigma)


def _past_marks(a: DataFrame, b: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Packed structures of a past the landmark structures of b: make(marks, row) -> columns of the result."""
    rows = packed(a)
    names = [c.split()[0] for c in schema.split(", ")]

    def one(block: DataFrame) -> DataFrame:
        marks = Marks([r.asDict() for r in block.limit(MAX_LANDMARKS + 1).collect()])  # one block
        shared = a.sparkSession.sparkContext.broadcast(marks)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["charges"] and len(shared.value.ids):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in make(shared.value, r)], names=names)

        return rows.mapInArrow(each, schema)

    return in_blocks(packed(b), "structure_id", one)


def local_kernel(a: DataFrame, b: DataFrame, sigma: float, metric: str = "l1") -> DataFrame:
    """(a_id, b_id, a_atom, b_atom, c) for atoms (structure_id, atom_id, z, features) of one element; atoms of different elements have 0 and no row.
    Structures of a stream past the landmark structures b, so no element's atoms meet in one task."""

    def make(marks: Marks, r: dict) -> list:
        same, c = marks.alike(r["charges"], r["atoms"], sigma, metric)
        i, j = np.nonzero(same)
        return [np.full(len(i), r["structure_id"], np.int64), marks.ids[marks.which[j]], np.array(r["numbers"], np.int32)[i], marks.numbers[j].astype(np.int32), c[i, j]]

    return _past_marks(a, b, make, "a_id long, b_id long, a_atom int, b_atom int, c double")


def delta_kernel(a: DataFrame, b: DataFrame, sigma: float) -> DataFrame:
    """(a_id, b_id, k): the sum of the local kernel over atoms of the same element; pairs without such atoms have no row."""

    def make(marks: Marks, r: dict) -> list:
        same, c = marks.alike(r["charges"], r["atoms"], sigma, "l1")
        k = np.add.reduceat(np.where(same, c, 0.0).sum(0), marks.start)
        some = np.add.reduceat(same.any(0).astype(np.int64), marks.start) > 0
        return [np.full(int(some.sum()), r["structure_id"], np.int64), marks.ids[some], k[some]]

    return _past_marks(a, b, make, "a_id long, b_id long, k double")


def logsumexp(m: np.ndarray, axis: int) -> np.ndarray:
    most = m.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(m - most).sum(axis=axis))


def sinkhorn(c: np.ndarray, gamma: float, rounds: int = 100, tol: float = 1e-9) -> float:
    """Sum of plan times kernel c, of the plan with uniform marginals that is least in cost plus gamma times negative entropy; the cost of a match
    is -ln(c + 1e-16). In logarithms, so no gamma underflows: the plan is exp(ln(c + 1e-16) / gamma + f_i + g_j), and f and g are solved
    for one marginal at a time, until the other one is off by at most tol or rounds are over."""
    if not c.size:
        return 0.0
    n, m = c.shape
    gain = np.log(c + 1e-16) / gamma
    g = np.zeros(m)
    for _ in range(rounds):
        f = -np.log(n) - logsumexp(gain + g, 1)
        g = -np.log(m) - logsumexp(gain + f[:, None], 0)
        plan = np.exp(gain + f[:, None] + g)
        if np.abs(plan.sum(1) - 1 / n).max() <= tol:
            break
    return float((plan * c).sum())


#: Widest span of gains, in nats, at which scalings of the kernel itself stay far from the ends of a double.
SPAN = 200.0
#: Numbers of a batch of kernels that are matched together.
BATCH = 1 << 15


def sinkhorns(c: np.ndarray, gamma: float, rounds: int = 100, tol: float = 1e-9) -> np.ndarray:
    """sinkhorn of every kernel c[:, :, k] of one shape. Each stops by its own rule. The scalings are those of sinkhorn without logarithms, while no gain can underflow
    or overflow; otherwise the logarithms of sinkhorn, one kernel at a time."""
    n, m, count = c.shape
    out = np.zeros(count)
    if not c.size:
        return out
    if rounds < 1 or -np.log(1e-16) / gamma > SPAN or c.max() > 2:
        return np.array([sinkhorn(c[:, :, k], gamma, rounds, tol) for k in range(count)])
    each = max(1, BATCH // (n * m))
    for at in range(0, count, each):
        own = np.ascontiguousarray(c[:, :, at : at + each])
        gain = np.exp(np.log(own + 1e-16) / gamma)
        v, left = np.ones((m, own.shape[2])), np.arange(at, at + own.shape[2])
        row = np.einsum("ijk,jk->ik", gain, v)
        for k in range(rounds):
            u = 1 / (n * row)
            v = 1 / (m * np.einsum("ijk,ik->jk", gain, u))
            row = np.einsum("ijk,jk->ik", gain, v)
            done = np.abs(u * row - 1 / n).max(0) <= tol
            if k == rounds - 1:
                done[:] = True
            if done.any():
                g, w = (gain, own) if done.all() else (gain[:, :, done], own[:, :, done])
                out[left[done]] = (u[:, done] * np.einsum("ijk,jk->ik", g * w, v[:, done])).sum(0)
                if done.all():
                    break
                keep = ~done
                gain, own, v, row, left = gain[:, :, keep], own[:, :, keep], v[:, keep], row[:, keep], left[keep]
    return out


def best_matches(same: np.ndarray, c: np.ndarray, sides: tuple[np.ndarray, np.ndarray], gamma: float, rounds: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The best-match kernel of the structures of one side with those of the other, where wanted (everywhere if None), else 0. same and c: of all their atoms, as Marks.alike
    gives them; sides: the sizes of the structures, whose atoms lie one after another. Pairs of one shape are matched together."""
    c = np.where(same, c, 0.0)
    begin = [np.cumsum(s) - s for s in sides]
    out = np.zeros((len(sides[0]), len(sides[1])))
    for n in np.unique(sides[0]):
        for m in np.unique(sides[1]):
            own = (sides[0] == n)[:, None] & (sides[1] == m)
            i, j = np.nonzero(own if wanted is None else own & wanted)
            each = max(1, 8 * BATCH // (n * m))
            for at in range(0, len(i), each):
                p, q = i[at : at + each], j[at : at + each]
                blocks = c[begin[0][p] + np.arange(n)[:, None, None], begin[1][q] + np.arange(m)[None, :, None]]
                out[p, q] = sinkhorns(blocks, gamma, rounds)
    return out


def best_match(a: DataFrame, b: DataFrame, sigma: float, gamma: float = 1.0, rounds: int = 100) -> DataFrame:
    """(a_id, b_id, k): the best-match kernel of the structures of atoms a (structure_id, atom_id, z, features) with the landmark structures of b.
    Structures stream past the landmarks, so a structure's atoms are sent once and not once a pair."""

    def make(marks: Marks, r: dict) -> list:
        same, c = marks.alike(r["charges"], r["atoms"], sigma, "l1")
        k = best_matches(same, c, (np.array([len(r["charges"])]), marks.sizes), gamma, rounds)[0]
        return [np.full(len(k), r["structure_id"], np.int64), marks.ids, k]

    return _past_marks(a, b, make, "a_id long, b_id long, k double")


def best_match_tiles(atoms: DataFrame, sigma: float, gamma: float = 1.0, rounds: int = 100, group: int | None = None) -> DataFrame:
    """The best-match kernel of the structures of atoms (structure_id, atom_id, z, features) with themselves, scaled so that every structure's kernel with itself
    is 1, as tiles (a, b, n_groups, ids_a, ids_b, k) between groups a <= b of about group structures; the other half is their mirror image. A task holds two
    groups of structures and one tile; kernels of structures with themselves are computed once a group. Without group, sets of more than 32 groups get larger ones, up to
    MOST_MATCH_GROUP structures, as every group is sent once for each other."""
    rows = packed(atoms)
    n = rows.count()
    n_groups = max(1, -(-n // (group or min(MOST_MATCH_GROUP, max(MATCH_GROUP, n // 32)))))

    def gather(t: pa.Table) -> pa.Table:
        marks = Marks(t.sort_by("structure_id").to_pylist())
        own = [sinkhorn(np.where(*marks.between(i, marks, i, sigma)), gamma, rounds) for i in range(len(marks.ids))]
        return pa.table({"grp": t.column("grp").slice(0, 1), "ids": pa.array([marks.ids.tobytes()], pa.binary()), "held": pa.array([pickle.dumps((marks, np.array(own)))], pa.binary())})

    groups = rows.withColumn("grp", group_of("structure_id", n_groups)).groupBy("grp").applyInArrow(gather, "grp int, ids binary, held binary")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (x, kx), (y, ky) = pickle.loads(r["helda"]), pickle.loads(r["heldb"])
                same, c = x.z[:, None] == y.z, np.exp(-l1_matrix(x.x, y.x) / sigma)
                ahead = x.ids[:, None] <= y.ids  # the lower identifier first: a match that rounds cut off isn't quite symmetric
                k = best_matches(same, c, (x.sizes, y.sizes), gamma, rounds, ahead)
                if r["a"] != r["b"]:
                    k += best_matches(same.T, c.T, (y.sizes, x.sizes), gamma, rounds, ~ahead.T).T
                k /= np.sqrt(kx[:, None] * ky)
                if r["a"] == r["b"]:
                    k = np.triu(k) + np.triu(k, 1).T
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((r["a"], pa.int32()), (r["b"], pa.int32()), (n_groups, pa.int32()), (r["idsa"], pa.binary()), (r["idsb"], pa.binary()), (k.tobytes(), pa.binary()))], names=["a", "b", "n_groups", "ids_a", "ids_b", "k"])

    return tiles_of(groups, n_groups, ["ids", "held"]).mapInArrow(tile, TILES)


def kernel_tiles(kernel: DataFrame, ids: DataFrame, group: int = TILE_GROUP) -> DataFrame:
    """A kernel of a set with itself, rows (a_id, b_id, k) of all pairs, as tiles between groups of the identifiers of ids (id)."""
    n_groups = max(1, -(-ids.count() // group))
    own = ids.select(F.col("id").cast("long").alias("id")).groupBy(group_of("id", n_groups).alias("grp")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    cells = kernel.select(group_of("a_id", n_groups).alias("a"), group_of("b_id", n_groups).alias("b"), F.col("a_id").cast("long").alias("i"), F.col("b_id").cast("long").alias("j"), F.col("k").cast("double").alias("k")).filter("a <= b")

    def one(t: pa.Table, u: pa.Table) -> pa.Table:
        r, out = (u.to_pylist() or [None])[0], []
        if r is not None:
            x, y = np.array(r["idsa"], np.int64), np.array(r["idsb"], np.int64)
            k = np.zeros((len(x), len(y)))
            k[np.searchsorted(x, t.column("i").to_numpy()), np.searchsorted(y, t.column("j").to_numpy())] = t.column("k").to_numpy()
            out = [(r["a"], r["b"], n_groups, x.tobytes(), y.tobytes(), k.tobytes())]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["a", "b", "n_groups", "ids_a", "ids_b", "k"])

    return cells.groupBy("a", "b").cogroup(tiles_of(own, n_groups, ["ids"]).groupBy("a", "b")).applyInArrow(one, TILES)


def from_tiles(tiles: DataFrame) -> DataFrame:
    """(a_id, b_id, k) of all pairs of tiles and their mirror image."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["ids_a"], np.int64), np.frombuffer(r["ids_b"], np.int64)
                k = np.frombuffer(r["k"], float)
                i, j = np.repeat(x, len(y)), np.tile(y, len(x))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(k)], names=["a_id", "b_id", "k"])
                if r["a"] != r["b"]:
                    yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(i), pa.array(k)], names=["a_id", "b_id", "k"])

    return tiles.mapInArrow(each, "a_id long, b_id long, k double")


def best_match_gram(atoms: DataFrame, sigma: float, gamma: float = 1.0, rounds: int = 100) -> DataFrame:
    """(a_id, b_id, k): best_match_tiles as rows of all pairs."""
    return from_tiles(best_match_tiles(atoms, sigma, gamma, rounds))


def normalized(k: DataFrame, own_a: DataFrame, own_b: DataFrame) -> DataFrame:
    """k / sqrt(k_aa k_bb), from (id, k) of both sides."""
    return k.join(own_a.select(F.col("id").alias("a_id"), F.col("k").alias("__ka")), "a_id").join(own_b.select(F.col("id").alias("b_id"), F.col("k").alias("__kb")), "b_id").select("a_id", "b_id", (F.col("k") / F.sqrt(F.col("__ka") * F.col("__kb"))).alias("k"))
