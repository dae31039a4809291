"""Starting streams and reading what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import Scratch


def events(spark: SparkSession, path: str, schema, delay: str | None = "1 hour", files: int = 1) -> DataFrame:
    """A stream of the Parquet files under ``path``; times without zone become instants, which watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", delay) if delay else stream


#: When the first file of a folder made by ``in_parts`` says it was written, in milliseconds; the next ones follow by a second each.
_FIRST = 1_700_000_000_000


def in_parts(df: DataFrame, scratch: Scratch, order: str, parts: int) -> str:
    """``df`` as ``parts`` files at most, in the order of an integer column, to be streamed one at a time.

    A stream takes files by the time of their last change. Parts are equal
    ranges of the column, cut at fixed places, and their times are set in that
    order: a later range can't come first, move the watermark and make the
    rows of an earlier one late.
    """
    path = scratch.path("parts")
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        df.write.parquet(path)
        return path
    span = high - low + 1
    cuts = [low + span * k // parts for k in range(parts + 1)]
    for k in range(parts):
        own = df.where((F.col(order) >= cuts[k]) & (F.col(order) < cuts[k + 1]))
        own.coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)
        in_order(scratch, path, k)
    return path


def in_order(scratch: Scratch, path: str, k: int) -> None:
    """Sets the times of the files that were added as part ``k`` after those of earlier parts."""
    jvm = scratch.spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(scratch.spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.listStatus(at):
        if status.getModificationTime() >= _FIRST + 1_000_000_000:  # not set yet
            system.setTimes(status.getPath(), _FIRST + 1000 * k, -1)


def finish(stream: DataFrame, scratch: Scratch, mode: str = "append") -> DataFrame:
    """Runs a stream over everything available and returns its sink as a batch.

    Appended rows go to a file sink, which records each batch once even if it
    is repeated. For complete and update modes every batch replaces the table
    of its number; the last table of complete mode is the result.
    """
    spark, out = stream.sparkSession, scratch.path("sink")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    numbers: list[int] = []

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{number}")
        numbers.append(number)

    writer.foreachBatch(batch).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/{numbers[-1]}")
    tables = [spark.read.schema(stream.schema).parquet(f"{out}/{n}").withColumn("batch", F.lit(n)) for n in numbers]
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result


def in_memory(stream: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Runs a stream in complete mode into a table in the driver's memory: for small results, as in tests and reports."""
    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True)
    writer.format("memory").queryName(name).start().awaitTermination()
    return stream.sparkSession.table(name)
