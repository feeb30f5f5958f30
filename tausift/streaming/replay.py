"""Batch operators over streams of files: keyed state by foreachBatch, windows with late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tausift.operators.incremental import latest
from tausift.runtime import shared_dir


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A stream of the parquet files of a table: a folder of parts, or one file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    if folder:
        return reader.parquet(path)
    parent, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(parent)


def latest_per_key(spark: SparkSession, stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of a bounded stream, kept as a table that every batch replaces.

    A batch writes a version of its own, from the version before it, so a batch that runs again gives the same table.
    """
    base = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch if number == 0 else session.read.parquet(f"{base}/v={number - 1}").unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{base}/v={number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    number = last["batchId"] if last else -1
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/v={number}")
    while number >= 0 and not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        number -= 1
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/v={number}")
    return spark.read.parquet(f"{base}/v={number}") if number >= 0 else spark.createDataFrame([], stream.schema)


def windowed_totals(spark: SparkSession, stream: DataFrame, at: str, group: str, value: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, group, n, total) per time window of a bounded stream.

    Every row counts, in whatever order the files come; the windows' state is then kept to the end. With `late`, windows that
    ended longer than that before the newest time of earlier batches are closed, and their rows are dropped.

    Every batch writes the windows it changed; the last version of each window counts.
    """
    base = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    timed = stream.withWatermark(at, late) if late else stream
    totals = timed.groupBy(F.window(at, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    flat = totals.select(F.col("w.start").alias("start"), group, "n", "total")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/b={number}")

    flat.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}-progress").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.option("basePath", base).parquet(f"{base}/b=*")
    return versions.groupBy("start", group).agg(F.max_by(F.struct("n", "total"), "b").alias("r")).select("start", group, "r.n", "r.total")
