"""Features of streams. A structure's features depend on no other structure, so each micro-batch runs the batch plan; element
factors are a running aggregate. Streams are an extension: there is no time in the data and so no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Write plan(batch) of every micro-batch below folder; a batch that runs again replaces its own files."""

    def run(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_factors(stream: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Mean absolute value by element and channel of rows (z, features), kept up to date in the in-memory table name: a row per element and channel,
    whatever the stream. Without a checkpoint folder the stream gets one of its own below spark.checkpoint.dir; a cluster must name one or the other, shared by all machines,
    and a local session may do without."""
    sc = stream.sparkSession.sparkContext
    if checkpoint is None:
        shared = sc._jsc.sc().getCheckpointDir()
        below = shared.get() if shared.isDefined() else sc.getConf().get("spark.checkpoint.dir")
        if below:
            checkpoint = f"{below.rstrip('/')}/{name}"
        elif not sc.master.startswith("local"):
            raise ValueError("name a checkpoint folder that all machines share")
    rows = stream.select("z", F.posexplode("features").alias("channel", "value"))
    factors = rows.groupBy("z", "channel").agg(F.avg(F.abs("value")).alias("factor")).withColumn("factor", F.when(F.col("factor") == 0, 1.0).otherwise(F.col("factor")))
    writer = factors.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
