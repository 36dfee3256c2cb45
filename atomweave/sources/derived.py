"""Atoms, vectors and targets derived from the relational tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task is dealt; what they become (pairs, cells, features) takes some ten to a hundred times their memory.
DEALT = 50_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by key in parts of about DEALT rows, so that a task's memory doesn't grow with the table; Spark's own number of parts is fixed, and it merges
    those that are small before they become pairs. Tables of a single such part stay as they are."""
    n = -(-rows.count() // DEALT)
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), key) if n > 1 else rows


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One atom for each row of lineitem; structures are orders. Dealt by structure, which later joins and sums reuse."""
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1
    q = F.col("l_quantity")
    return rows.select(
        F.col("l_orderkey").alias("structure_id"),
        number.alias("atom_id"),
        (F.lit(1) + F.col("l_partkey") % 92).cast("int").alias("z"),
        (q - 10.0 * F.floor(q / 10.0)).alias("x"),
        ((F.col("l_partkey") % 97) / F.lit(9.7)).alias("y"),
        ((F.col("l_suppkey") % 89) / F.lit(8.9)).alias("zc"),
    )


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms gathered into one row a structure, in atom order."""
    a = atoms(spark, sf_dir).groupBy("structure_id").agg(F.array_sort(F.collect_list(F.struct("atom_id", "z", "x", "y", "zc"))).alias("a"))
    return a.select("structure_id", F.transform("a", lambda v: v["z"].cast("double")).alias("charges"), F.transform("a", lambda v: F.array(v["x"], v["y"], v["zc"])).alias("coords"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, z, features): embeddings as feature vectors, their label as element."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("z"), F.col("embedding").cast("array<double>").alias("features"))


def long_form(rows: DataFrame, *keys: str, features: str = "features") -> DataFrame:
    """(keys, channel, value)."""
    return rows.select(*keys, F.posexplode(features).alias("channel", "value"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("structure_id"), F.col("o_totalprice").alias("target"))


def crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crystal for each supplier, as STRUCTURES: 16 sites on a face-centred lattice of two by two cells, moved and given elements by the supplier's key."""
    k, edge = F.col("s_suppkey"), "(3.8D + (s_suppkey % 11) / 10.0D)"
    face = [(0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)]
    sites = [(x + i, y + j, z) for i in range(2) for j in range(2) for x, y, z in face]
    moved = lambda v, n, m: f"{v}D * {edge} + ((s_suppkey * {n}) % {m}) / {10.0 * m}D"
    coords = F.array(*[F.expr(f"array({moved(x, 3 * s + 7, 101)}, {moved(y, 5 * s + 11, 103)}, {moved(z, 7 * s + 13, 107)})") for s, (x, y, z) in enumerate(sites)])
    charges = F.array(*[F.expr(f"double(1 + (s_suppkey * {s % 4 + 1} + {s % 3}) % 83)") for s in range(len(sites))])
    cell = F.expr(f"array(array(2.0D * {edge}, 0.0D, 0.0D), array(0.0D, 2.0D * {edge}, 0.0D), array(0.0D, 0.0D, {edge}))")
    pbc = F.struct(*[F.lit(True).alias(n) for n in "abc"])
    return table(spark, sf_dir, "supplier").select(k.cast("long").alias("structure_id"), charges.alias("charges"), coords.alias("coords"), cell.alias("cell"), pbc.alias("pbc"), F.lit(None).cast("double").alias("target"))


def trajectories(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """n frames of each supplier's crystal, with a column frame: a frame moves atoms by 0.06 down, not at all or up along an axis, by (number + axis) modulo 3."""
    frames = crystals(spark, sf_dir).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    step = lambda i, k: F.col("frame") * 0.06 * (F.pmod(i + k, F.lit(3)) - 1)
    return frames.withColumn("coords", F.transform("coords", lambda p, i: F.array(*[p[k] + step(i, k) for k in range(3)])))


def waves(seed: int, rows: int, columns: int) -> list[list[float]]:
    """A matrix of fixed numbers, for models whose weights aren't learned here."""
    return [[round(math.sin(seed + 3 * i + 7 * j) / math.sqrt(columns), 6) for j in range(columns)] for i in range(rows)]
