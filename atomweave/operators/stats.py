"""Statistics of features, targets and runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import moments


def standardize(train: DataFrame, test: DataFrame, key: str = "channel", value: str = "value") -> DataFrame:
    """test (.., key, value) with the mean and population deviation of train; deviations of 0 count 1."""
    fit = train.groupBy(key).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    sd = F.when(F.col("__sd") == 0, 1.0).otherwise(F.col("__sd"))
    return test.join(F.broadcast(fit), key).withColumn(value, (F.col(value) - F.col("__mean")) / sd).drop("__mean", "__sd")


def correlations(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """(a, b, r) for channels a < b of rows (id, channel, value): one self-join by row, one aggregate."""
    a = rows.select(id_col, F.col("channel").alias("a"), F.col("value").alias("__x"))
    b = rows.select(id_col, F.col("channel").alias("b"), F.col("value").alias("__y"))
    return a.join(b, id_col).filter("a < b").groupBy("a", "b").agg(F.corr("__x", "__y").alias("r"))


def correlations_wide(reps: DataFrame, width: int) -> DataFrame:
    """As correlations from arrays of a known width: each Arrow block adds to one width x width matrix of products, and only its sum is turned
    into coefficients, so rows are neither multiplied nor shuffled."""
    m = moments(reps.select(F.slice("features", 1, width).alias("features"), F.lit(1.0).alias("target"))).get(0)
    kind = "a int, b int, r double"
    if m is None:
        return reps.sparkSession.createDataFrame([], kind)
    cov = m.yy * m.xx - np.outer(m.xy, m.xy)
    sd = np.sqrt(np.diag(cov))
    pairs = [(i, j, float(cov[i, j] / (sd[i] * sd[j])) if sd[i] * sd[j] > 0 else None) for i in range(width) for j in range(i + 1, width)]
    return reps.sparkSession.createDataFrame(pairs, kind)


def correlation_counts(corr: DataFrame, levels: tuple[float, ...] = (0.95, 0.8)) -> DataFrame:
    """(level, n): channel pairs whose absolute correlation exceeds each level."""
    one = corr.agg(*[F.count_if(F.abs("r") > x).alias(f"n{i}") for i, x in enumerate(levels)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"n{i}").alias("n")) for i, x in enumerate(levels)])).alias("x")).select("x.*")


def variances(rows: DataFrame, least: float = 1e-6) -> DataFrame:
    """(channel, variance, constant): population variance of each channel and whether it is near 0."""
    return rows.groupBy("channel").agg(F.var_pop("value").alias("variance")).withColumn("constant", F.col("variance") < least)


def mae(rows: DataFrame, keys: list[str], truth: str = "y", guess: str = "p") -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"))


def fold_summary(maes: DataFrame, keys: list[str]) -> DataFrame:
    return maes.groupBy(*keys).agg(F.avg("mae").alias("mean"), F.stddev_pop("mae").alias("sd"))


def best_setting(maes: DataFrame, settings: list[str], keys: list[str] | None = None) -> DataFrame:
    """The setting with the least error; ties go to the least setting."""
    best = F.min(F.struct("mae", *settings)).alias("b")
    return maes.groupBy(*(keys or [])).agg(best).select(*(keys or []), *[f"b.{c}" for c in settings], "b.mae")


def ranked(rows: DataFrame, value: str, id_col: str = "channel") -> DataFrame:
    """rows with rank by descending absolute value, ties by identifier. For a row per channel or feature."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs(value)), id_col)))


def top_sets(rank: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, channel): the best so many channels."""
    return rank.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).filter("rank <= size").select("size", "channel")


def importance(rows: DataFrame) -> DataFrame:
    """Mean importance by block, and by block and order (m is null for the block as a whole)."""
    return rows.groupingSets([[F.col("block")], [F.col("block"), F.col("m")]], "block", "m").agg(F.avg("importance").alias("mean"))


def spread(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Largest minus least value of each group: 0 where atoms are equivalent."""
    return rows.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread"))


def percent_change(rows: DataFrame, order: str, value: str) -> DataFrame:
    before = F.lag(value).over(Window.orderBy(order))
    return rows.withColumn("change", 100.0 * (F.col(value) - before) / before)


def against_first(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Percent improvement over the first row."""
    first = F.first_value(value).over(Window.orderBy(order))
    return rows.withColumn("improvement", 100.0 * (first - F.col(value)) / first)


def extrapolate(curve: DataFrame, goal: float, n: str = "n", error: str = "mae", points: int = 3) -> DataFrame:
    """One row: slope of log error over log n between the last point and the one points - 1 before it, and the n at which the error reaches goal."""
    w = Window.orderBy(n)
    x, y = F.log(F.col(n).cast("double")), F.log(error)
    rows = curve.select(n, x.alias("x"), y.alias("y")).withColumn("x0", F.lag("x", points - 1).over(w)).withColumn("y0", F.lag("y", points - 1).over(w))
    last = rows.agg(F.max_by(F.struct("x", "y", "x0", "y0"), n).alias("l")).select("l.*")
    slope = (F.col("y") - F.col("y0")) / (F.col("x") - F.col("x0"))
    return last.select(slope.alias("slope"), F.exp(F.col("x") + (F.log(F.lit(float(goal))) - F.col("y")) / slope).alias("n_goal"))


def layer_means(rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, norm): the norm of a group's mean vector, of rows (groups, channel, value)."""
    means = rows.groupBy(*groups, "channel").agg(F.avg("value").alias("v"))
    return means.groupBy(*groups).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def describe(rows: DataFrame, size: Column, target: Column) -> DataFrame:
    agg = [f(c).alias(f"{n}_{k}") for c, k in ((size, "atoms"), (target, "target")) for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    return rows.agg(F.count(F.lit(1)).alias("n"), *agg)


def median_time(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.median("seconds").alias("median"))
