"""Structured Streaming forms: replies arrive, the first of each key stays, counts follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def first_of_key(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first record of each key; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counted(stream: DataFrame, time: str, width: str, by: str, late: str = "1 hour") -> DataFrame:
    """Records and mean value for each window and group."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")


def appended(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what has arrived and stops; a restart goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def written_once(stream: DataFrame, path: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """A stream written so that each of its rows is there once, however often a batch is run again.

    Batch n is the folder `batch=n`, written whole or not at all, and over what a
    run that was killed has left there. also(rows, n) is a step that may fail
    without losing or doubling rows: the batch is then run again at the next
    start, from the checkpoint's last finished one.
    """

    def put(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if also:
            also(rows, n)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpointed(df: DataFrame, path: str, order: str, every: int, finish: Callable[[DataFrame], DataFrame]) -> list[str]:
    """The parts of a long computation that this run wrote: finish(rows) of ranges of `order`, `every` values each.

    A part that an earlier run has finished is left alone; one that can't be
    written is left out and told as such by its absence, and the others go on.
    `order` is a whole number that rises from 0.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last, wrote = df.agg(F.max(order)).first()[0], []
    for k in range(0 if last is None else last // every + 1):
        part = f"{path}/part={k}"
        if fs.exists(hadoop.Path(part, "_SUCCESS")):
            continue
        rows = df.where((F.col(order) >= k * every) & (F.col(order) < (k + 1) * every))
        try:
            finish(rows).write.mode("overwrite").parquet(part)
            wrote.append(part)
        except Exception as error:  # the next run writes it
            print(f"part {k} is not written: {str(error).splitlines()[0][:200]}")
    return wrote
