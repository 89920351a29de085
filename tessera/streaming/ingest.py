"""Streams of scans into batch results: every micro-batch is matched, appended and reported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process(stream: DataFrame, match: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, once: bool = True):
    """Run match on every micro-batch and append its rows, with batch_no; a repeated micro-batch replaces its own rows.

    match returns one row a scan, with a null error where it worked, so that one bad scan costs no other.
    """

    def write(df: DataFrame, batch_no: int) -> None:
        out = match(df).withColumn("batch_no", F.lit(batch_no))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(results)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return q.trigger(availableNow=True).start() if once else q.start()


def file_stream(spark: SparkSession, folder: str, schema, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of key in event-time windows, with a watermark for late rows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
