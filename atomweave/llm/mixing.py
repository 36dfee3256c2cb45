"""Mixing of sources to target weights.

Documents get a hash-random key (of identifier and text). The key space is cut into ranges, so (source, range) holds some
hundred rows however large a source is; a range that equal rows crowd is cut again by the rows' own numbers. Word counts are
summed by range, the sums are turned into offsets in two levels (blocks of ranges, then ranges in a block), and a running
sum inside a range, which Spark sorts by key, finishes the distributed prefix sum. Each source is cut at its exact
budget: whole epochs first, then the documents in key order until the rest of the budget is spent; the last document gives
the words that are missing. One row per source passes through one task when weights are shared out; documents never do.

Defined results: null text has size 0; a null source is a source of its own, ordered last; null or repeated identifiers are
ordinary rows (equal rows are interchangeable); sources of size 0 get target 0; words of texts of any length are counted whole;
an empty table gives an empty result; mixed_rows returns the caller's columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, inner, located, null_safe_key, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
ROWS_A_RANGE = 128
RANGES_A_BLOCK = 4096
#: Ranges that are cut again are at most so many, each into at most so many parts.
MOST_CROWDED = 20_000
MOST_PARTS = 4096


def n_words(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(__source, source_size) of every source -> with target: weights repeat over the sources in code point order; what exceeds most times a source's size is shared again by weight."""
    rank = F.row_number().over(Window.orderBy("__source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("__w", w).withColumn("__cap", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__budget", F.lit(share) * F.sum("source_size").over(everything))
    s = s.withColumn("__level", (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
    s = s.withColumn("__free", F.col("__cap") > F.col("__level") * F.col("__w"))
    level = F.min(F.when(F.col("__free"), F.struct(F.col("__cap") / F.col("__w"), F.col("__source"), F.col("__level")))).over(everything)["__level"]
    s = s.withColumn("__level", level)
    return s.select("__source", "source_size", F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__level") * F.col("__w"))).alias("target"))


def shares(sized: DataFrame, weights, share: float, most: float) -> DataFrame:
    """sized (__at, __source, size, __key) -> with source_size, target, taken."""
    by_source = sized.groupBy("__source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    rows = by_source.agg(F.sum("__rows")).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(2, rows / ROWS_A_RANGE))))
    sized = sized.withColumn("__range", F.shiftrightunsigned(F.col("__key"), 64 - bits))
    # a range beyond the limit holds many equal rows; it is cut again, by the next bits of the key and then by the rows' own numbers
    crowded = sized.groupBy("__source", "__range").agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > max(16 * ROWS_A_RANGE, -(-rows // MOST_CROWDED)))
    crowded = F.broadcast(crowded.withColumn("__parts", F.least(F.lit(MOST_PARTS), F.ceil(F.col("__rows") / (16 * ROWS_A_RANGE)))).drop("__rows"))  # at most MOST_CROWDED rows
    finer = F.shiftrightunsigned(F.shiftleft(F.col("__key"), bits), 44) * MOST_PARTS + F.pmod(F.xxhash64("__at"), "__parts")
    sized = sized.join(crowded, ["__source", "__range"], "left").withColumn("__part", F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(finer)).drop("__parts")
    ranges = sized.groupBy("__source", "__range", "__part").agg(F.sum("size").alias("__sum"))
    ranges = ranges.withColumn("__block", F.floor(F.col("__range") / RANGES_A_BLOCK))
    blocks = ranges.groupBy("__source", "__block").agg(F.sum("__sum").alias("__block_sum"))
    ahead = Window.partitionBy("__source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__block_ahead", F.coalesce(F.sum("__block_sum").over(ahead), F.lit(0)))
    blocks = blocks.join(source_targets(by_source.select("__source", "source_size"), weights, share, most), "__source").drop("__block_sum")
    inside = Window.partitionBy("__source", "__block").orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("__in_block", F.coalesce(F.sum("__sum").over(inside), F.lit(0))).join(blocks, ["__source", "__block"])
    offsets = offsets.select("__source", "__range", "__part", "source_size", "target", (F.col("__block_ahead") + F.col("__in_block")).alias("__ahead"))
    own = Window.partitionBy("__source", "__range", "__part").orderBy(F.shiftrightunsigned(F.col("__key"), 1), "__key", "size", "__at").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.join(offsets, ["__source", "__range", "__part"]).withColumn("__ahead", F.col("__ahead") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("__ahead")))
    return out.withColumn("taken", taken)


def random_key(id_: Column, text: Column, seed: int) -> Column:
    """A hash of identifier and text: rows without identifier, or that share one, are spread by their texts."""
    return F.xxhash64(id_, F.lit(seed), F.xxhash64(text_of(text)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> DataFrame:
    """One row per document: identifier, size, source_size, target, taken."""
    light = df.select(F.col(id_col).alias("__id"), null_safe_key(F.col(source_col)).alias("__source"), n_words(F.col(text_col)).alias("size"), random_key(F.col(id_col), F.col(text_col), seed).alias("__key"))
    light = checkpointed(light).withColumn("__at", F.monotonically_increasing_id())
    return shares(light, weights, share, most).select(F.col("__id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> DataFrame:
    """The mix as rows of df: a document stands as often as the mix begins it (taken / size, rounded up); a document without words, which costs nothing, stands once."""
    rows = located(df)
    light = rows.select("__at", null_safe_key(inner(source_col)).alias("__source"), n_words(inner(text_col)).alias("size"), random_key(inner(id_col), inner(text_col), seed).alias("__key"))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    plan = shares(checkpointed(light), weights, share, most).select("__at", times.alias("__times")).filter("__times > 0")
    return rows.join(plan, "__at").withColumn("__time", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")
