"""Incremental runs: file streams with checkpoints, skipping of finished work, and step states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(
    spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files: int = 1
) -> DataFrame:
    """Work through the files of ``source`` not seen before, ``files`` at a time, appending to ``target``.

    The checkpoint makes a second call go on after the last finished batch; a batch that failed is done again and
    written once.  Returns the whole target.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    run = work(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.parquet(target)


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the finished versions ``v<number>`` under ``target``, ascending."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def upsert_batches(spark: SparkSession, source: str, schema, key: str, order: str, target: str, checkpoint: str) -> DataFrame:
    """Latest row of each key over all batches; batch n writes version n of the table from the last one before it.

    The state is what lies under ``target``, so a later call, in another process too, goes on from there; a batch that
    is done again after a failure starts from the same version and gives the same.  Of equal ``order`` the row whose
    other columns are greater stays.  Without any batch the table is empty.
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = [v for v in versions(spark, target) if v < number]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{target}/v{before[-1]}")) if before else batch
        latest = rows.groupBy(key).agg(F.max(F.struct(order, *(c for c in rows.columns if c not in (key, order)))).alias("r"))
        latest.select(key, "r.*").select(*rows.columns).write.mode("overwrite").parquet(f"{target}/v{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = versions(spark, target)
    return spark.read.schema(schema).parquet(f"{target}/v{last[-1]}") if last else spark.createDataFrame([], schema)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per tumbling window and key; events later than ``late`` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), key, "n"
    )


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events of a key without a gap of ``gap``."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n"
    )


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the finished ones."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def memoised(rows: DataFrame, column: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the distinct values of a column (columns ``column`` and results), joined back to all rows."""
    return rows.join(work(rows.select(column).where(F.col(column).isNotNull()).distinct()), column, "left")
