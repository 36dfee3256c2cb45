"""Rows keep their numbers when the settings that split files change between building a query and running it."""

import pytest
from pyspark.sql import functions as F

from atomweave.llm import exact_dedup, mixing, simhash, suffix_dedup
from atomweave.llm.common import located

SETTINGS = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "documents.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.union(docs.limit(30)).repartition(7).write.option("parquet.block.size", 20_000).parquet(path)
    return path


def moved(spark, path, make):
    """The rows of make(table), built under one way of splitting files and run under another, and those without a change."""
    key = lambda r: [(x is None, str(x)) for x in r]
    plain = sorted(make(spark.read.parquet(path)).collect(), key=key)
    before = {s: spark.conf.get(s, None) for s in SETTINGS}
    try:
        built = make(spark.read.parquet(path))
        spark.conf.set(SETTINGS[0], "9000")
        spark.conf.set(SETTINGS[1], "100")
        spark.conf.set(SETTINGS[2], "40")
        changed = sorted(built.collect(), key=key)
    finally:
        for s, v in before.items():
            spark.conf.unset(s) if v is None else spark.conf.set(s, v)
    return plain, changed


@pytest.mark.parametrize("name", ["op9", "exact", "near", "mixed"])
def test_rows_stay_the_same(spark, files, name):
    make = {"op9": lambda d: suffix_dedup.drop_repeats(d, digest=True), "exact": exact_dedup.drop_exact, "near": simhash.drop_near, "mixed": mixing.mixed_rows}[name]
    plain, changed = moved(spark, files, make)
    assert len(plain) > 50 and plain == changed


def test_numbers_are_distinct_and_settings_are_left_alone(spark, files):
    before = {s: spark.conf.get(s, None) for s in SETTINGS}
    for d in (spark.read.parquet(files), spark.read.parquet(files).withColumn("more", F.explode(F.array(F.lit(1), F.lit(2)))), spark.range(20).withColumn("text", F.lit("x"))):
        got = located(d)
        assert got.select("__at").distinct().count() == d.count() == got.count()
    assert {s: spark.conf.get(s, None) for s in SETTINGS} == before


def test_copies_of_a_hot_text(spark):
    d = spark.createDataFrame([(k, k % 40, ("abcdefghij" * 12 if k % 3 else f"other text {k % 5} " * 9)) for k in range(120)], "row long, id long, text string").withColumn("text", F.col("text").cast("binary"))
    want = sorted(map(tuple, suffix_dedup.whole_copies(d).collect()))
    assert sorted(map(tuple, suffix_dedup.whole_copies(d, hot_rows=10).collect())) == want and len(want) == 120 - 6
