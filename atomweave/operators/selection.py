"""Filters, labels, samples, splits and folds. Random order is a hash of the identifier, so any engine and rerun gives the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS, FACTOR = 4294967296, 2654435761


def small(s: DataFrame, most: int) -> DataFrame:
    return s.filter(F.size("charges") <= most)


def size_bins(sizes: DataFrame, bins: list[tuple[int, int]], size: str = "n_atoms") -> DataFrame:
    """Rows with the bin (low to high, inclusive) of their size; rows outside all bins are dropped."""
    label = F.coalesce(*[F.when(F.col(size).between(lo, hi), F.lit(f"{lo}-{hi}")) for lo, hi in bins])
    return sizes.withColumn("bin", label).filter("bin is not null")


def composition(s: DataFrame, species: tuple[int, int] = (1, 99), most_z: int = 118, most_atoms: int = 10**9, has: tuple[int, ...] = ()) -> DataFrame:
    """Structures by number of distinct elements, largest element, size and elements they must hold."""
    kinds = F.size(F.array_distinct("charges"))
    ok = kinds.between(*species) & F.forall("charges", lambda z: z <= most_z) & (F.size("charges") <= most_atoms)
    for z in has:
        ok = ok & F.array_contains("charges", float(z))
    return s.filter(ok)


def channels(features: Column, keep: list[int]) -> Column:
    """The listed channels of an array."""
    return F.array(*[F.get(features, F.lit(k)) for k in keep])


def block(orders: int, weights: int, most_order: int | None = None, skip_weight: int | None = None, offset: int = 0) -> list[int]:
    """Channels of a block by order and weight."""
    return [offset + m * weights + w for m in range(orders) for w in range(weights) if (most_order is None or m <= most_order) and w != skip_weight]


def labels(spark, orders: int = 5, radial: int = 4, angular: int = 4) -> DataFrame:
    """(channel, block, m, weight, label) of the default layout."""
    c = F.col("id").cast("int")
    n = orders * radial
    first = c < n
    at = F.when(first, c).otherwise(c - n)
    per = F.when(first, F.lit(radial)).otherwise(F.lit(angular))
    m, w = F.floor(at / per).cast("int"), (at % per).cast("int")
    name = F.when(first, "radial").otherwise("angular")
    return spark.range(n + orders * angular).select(c.alias("channel"), name.alias("block"), m.alias("m"), w.alias("weight"), F.format_string("%s m=%d w=%d", name, m, w).alias("label"))


def shuffle_key(id_col: str, seed: int) -> Column:
    """A multiplicative hash that no identifier overflows; the seed is a second odd factor, so seeds give unrelated orders."""
    return (F.pmod(F.col(id_col), F.lit(2**31)) * FACTOR % MODULUS * (2 * seed + 1) + seed) % MODULUS


#: Rows of a bucket of the hash range, about.
BUCKET_ROWS = 100_000


def shuffled_rank(rows: DataFrame, id_col: str, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with rank (from 1) in hash order. The hash range is cut into buckets of about bucket_rows whose counts are summed first, so no task orders
    more than a bucket, however large the table."""
    n = rows.select(id_col).count()
    buckets = 1 << min(20, max(6, math.ceil(math.log2(max(1, n / bucket_rows)))))  # at most a million counts, one row each
    key = shuffle_key(id_col, seed)
    part = F.floor(key / (MODULUS // buckets))
    own = rows.withColumn("__key", key).withColumn("__part", part)
    counts = own.groupBy("__part").count()
    ahead = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", ahead.alias("__ahead"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__key", id_col))
    return own.join(F.broadcast(offsets), "__part").withColumn("rank", inside + F.col("__ahead")).drop("__key", "__part", "__ahead")


def sample(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, ordered by identifier."""
    return rows.orderBy(shuffle_key(id_col, seed), id_col).limit(n).orderBy(id_col)


def split(rows: DataFrame, id_col: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows with part: test for the first ceil(share n) in hash order, else train."""
    ranked = shuffled_rank(rows, id_col, seed)
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    return ranked.join(F.broadcast(n)).withColumn("part", F.when(F.col("rank") <= F.ceil(share * F.col("__n")), "test").otherwise("train")).drop("__n", "rank")


def folds(rows: DataFrame, id_col: str, k: int = 5, seed: int = 18012019) -> DataFrame:
    """rows with fold 1..k of sizes that differ by one at most, the larger ones first, in hash order."""
    ranked = shuffled_rank(rows, id_col, seed)
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    base, more = F.floor(F.col("__n") / k), F.col("__n") % k
    at = F.col("rank") - 1
    fold = F.when(at < more * (base + 1), F.floor(at / (base + 1))).otherwise(more + F.floor((at - more * (base + 1)) / F.greatest(base, F.lit(1)))) + 1
    return ranked.join(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("__n", "rank")


def prefixes(rows: DataFrame, id_col: str, sizes: list[int], seed: int = 42) -> DataFrame:
    """(size, id): nested training sets, the first so many rows in hash order; sizes beyond the table are left out."""
    ranked = shuffled_rank(rows.select(id_col), id_col, seed)
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    wanted = F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: (s <= F.col("__n")) & (s >= F.col("rank"))))
    return ranked.join(F.broadcast(n)).select(id_col, wanted.alias("size"))


def without(rows: DataFrame, others: DataFrame, id_col: str) -> DataFrame:
    return rows.join(others.select(id_col), id_col, "left_anti")


def gather(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return rows.join(ids.select(id_col), id_col, "left_semi")


def centered(rows: DataFrame, value: str) -> DataFrame:
    mean = rows.agg(F.avg(value).alias("__mean"))
    return rows.join(F.broadcast(mean)).withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")


def boxed(s: DataFrame, shift: float = 25.0, box: float = 50.0) -> DataFrame:
    """Molecules moved into a cubic cell without periodic sides."""
    cell = F.array(*[F.array(*[F.lit(box if i == j else 0.0) for j in range(3)]) for i in range(3)])
    moved = F.transform("coords", lambda p: F.transform(p, lambda x: x + shift))
    return s.withColumn("coords", moved).withColumn("cell", cell).withColumn("pbc", F.struct(*[F.lit(False).alias(a) for a in "abc"]))
