"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a local session gets a folder of its own; a cluster must name one that all machines share."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, read again, and the path of the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str | None) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    if path is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: File names up to this many (about 10 MB) are broadcast to number rows; beyond it Spark chooses the join.
MOST_FILES = 50_000


def by_file(df: DataFrame, *columns: Column) -> DataFrame | None:
    """Columns of a plain read of Parquet files, with __at: the number of the file (in the order of names) times 2^33 plus the row's place in it.
    It belongs to the row, so it doesn't follow how a read is split. None if df isn't such a read. Only file names reach the driver, as in Spark's own listing."""
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":  # a join or an explode can repeat the rows of a file
        return None
    try:
        rows = df.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    except AnalysisException:  # another format
        return None
    names = sorted(r[0] for r in rows.select("__file").distinct().collect())
    files = df.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "__file string, __number long")
    rows = rows.join(F.broadcast(files) if len(names) <= MOST_FILES else files, "__file")
    return rows.withColumn("__at", F.shiftleft("__number", 33) + F.col("__index")).drop("__file", "__number", "__index")


def located(df: DataFrame) -> DataFrame:
    """(__row, __at): each row as one struct beside a number of its own, the same in every action, whatever settings plan it. A table that isn't
    read straight from Parquet is written to the shared folder first. Inside the struct no column of the caller clashes with a helper column."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    found = by_file(df, row)
    return by_file(written(df.select(row), "rows")[0], F.col("__row")) if found is None else found


def only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of a located table whose __at is in kept, as they were. The join key is a row's own number, so no group of rows meets in one task."""
    return rows.join(kept.select("__at"), "__at", "left_semi").select("__row.*")


def inner(column: str) -> Column:
    """A column of a located row."""
    return F.col("__row").getField(column)


def text_of(column: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def null_safe_key(column: Column) -> Column:
    """A non-null string key: null sorts after every value and equals itself."""
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column.cast("string")))


def fixed_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


HOT_ROWS = 100_000
MOST_HOT = 20_000


def told(rows: DataFrame, groups: DataFrame, on: list[str], hot_rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with groups, one row a key with __n, the number of its rows. Keys of more than hot_rows rows and more than
    a MOST_HOT-th of all (so there are fewer than MOST_HOT of them) are broadcast and their rows stay where they are; the others meet by key."""
    total = groups.agg(F.sum("__n")).first()[0] or 0
    is_hot = F.col("__n") > max(hot_rows, -(-total // MOST_HOT))
    hot = F.broadcast(groups.filter(is_hot))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(groups.filter(~is_hot), on, how))
