"""Writers: partitioned indexes with a manifest, exports, metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_index(df: DataFrame, path: str, meta: dict | None = None) -> None:
    """card_id, embedding, ... by set_code and finish_group; only the partitions in df are replaced. The manifest is a
    one-row JSON table beside it. Rows are gathered by partition, and AQE splits those of a large set over tasks."""
    df.hint("rebalance", "set_code", "finish_group").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_code", "finish_group").parquet(path)
    spark = df.sparkSession
    row = spark.read.parquet(path).agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dim"), F.countDistinct("set_code").alias("sets"))
    row.withColumn("meta", F.lit(json.dumps(meta or {}, sort_keys=True))).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_manifest")


def _files(df: DataFrame, single: bool) -> DataFrame:
    return df.coalesce(1) if single else df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """One header a file and quoted fields. `single` puts all rows into one task and file: for exports of one batch only."""
    _files(df, single).write.mode("overwrite").option("header", True).option("quoteAll", False).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    _files(df, single).write.mode("overwrite").json(path)


def append(df: DataFrame, path: str) -> None:
    """Append to a log; a job's files appear together or not at all."""
    df.write.mode("append").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """One row a record, as a JSON text with nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
