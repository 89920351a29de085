"""Readers of images, sidecars, bulk catalogues, prediction and gold files, and stored indexes."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas

IMAGE = r"(?i)\.(jpg|jpeg|png|webp)$"
SCAN = r"(?i)\.(jpg|jpeg|png|webp|bmp)$"
UPLOAD = r"(?i)\.(jpg|jpeg|png)$"


def images(spark: SparkSession, folder: str, pattern: str = IMAGE, content: bool = True) -> DataFrame:
    """path, modificationTime, length (and content) of the images under folder; without content only metadata is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(pattern))
    return df if content else df.drop("content")


def catalogue_images(spark: SparkSession, root: str, set_code: str, finish: str, content: bool = True) -> DataFrame:
    """Images of <root>/<set>/<finish>/; where there is no such folder, those of the set whose path suits the finish. In path order."""
    rows = images(spark, f"{root}/{set_code}", content=content)
    tail = F.lower(F.element_at(F.split(F.col("path"), f"/{set_code}/"), -1))
    own = rows.where(tail.startswith(f"{finish}/"))
    if own.limit(1).count():
        return own.orderBy("path")
    suits = {"foil": tail.contains("foil") & ~tail.contains("nonfoil"), "etched": tail.contains("etched")}.get(finish, ~tail.contains("foil") | tail.contains("nonfoil"))
    return rows.where(suits).orderBy("path")


def unpacked(paths: list[str], folder: str) -> list[str]:
    """Unpack archives and list the images among paths; ValueError if there are none."""
    out = []
    for p in paths:
        if p.lower().endswith(".zip"):
            with zipfile.ZipFile(p) as z:
                for name in z.namelist():
                    if name.lower().endswith((".jpg", ".jpeg", ".png")) and ".." not in name.split("/"):
                        out.append(z.extract(name, folder))
        elif p.lower().endswith((".jpg", ".jpeg", ".png")):
            out.append(os.path.abspath(p))
    if not out:
        raise ValueError("no images")
    return sorted(out)


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """path and fields of each JSON sidecar; unreadable files give rows of nulls."""
    return spark.read.schema(schemas.SOURCE_ITEM).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder).withColumn("path", F.col("_metadata.file_path"))


def bulk_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a bulk catalogue: one JSON array, or one object a line."""
    lines = not path.endswith(".json")
    return spark.read.schema(schemas.SOURCE_ITEM).option("multiLine", not lines).json(path)


def _last(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key in file order."""
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    w = Window.partitionBy(key).orderBy(F.desc("place"))
    return df.withColumn("place", place).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "place")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """path, match_id, confidence, seconds, candidates from a predictions CSV; the last row of a path counts.

    candidates is a JSON list of ids or of objects with card_id; broken JSON reads as an empty list.
    """
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    for c in ("match_card_id", "matched_card_id", "confidence", "candidates", "processing_time"):
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    objects = F.transform(F.from_json("candidates", "array<struct<card_id:string>>"), lambda x: x["card_id"])
    ids = F.from_json("candidates", "array<string>")
    listed = F.when(F.col("candidates").rlike(r"^\s*\[\s*\{"), objects).otherwise(ids)
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0))
    return _last(raw, "scanned_path").select(
        F.col("scanned_path").alias("path"),
        F.coalesce(F.nullif(F.col("match_card_id"), F.lit("")), F.col("matched_card_id"), F.lit("")).alias("match_id"),
        number("confidence").alias("confidence"),
        number("processing_time").alias("seconds"),
        F.coalesce(listed, F.array().cast("array<string>")).alias("candidates"),
    )


def gold(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return _last(raw, "scanned_path").select(F.col("scanned_path").alias("path"), F.col("correct_card_id").alias("gold_id"))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a corrections CSV as strings; a missing file has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "scanned_path string, correct_card_id string")
    return spark.read.option("header", True).csv(path)


def expectations(spark: SparkSession, path: str) -> DataFrame:
    """file, exp_name, exp_set, exp_number, exp_confidence from a JSON map of file names."""
    inner = "struct<card_name:string,set_code:string,collector_number:string,confidence:double>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{inner}>")).alias("file", "e"))
    return rows.select("file", F.col("e.card_name").alias("exp_name"), F.col("e.set_code").alias("exp_set"), F.col("e.collector_number").alias("exp_number"), F.col("e.confidence").alias("exp_confidence"))


def index(spark: SparkSession, path: str, set_code: str | None = None, finish_group: str | None = None) -> DataFrame:
    """The stored index: all of it, or the partitions asked for."""
    df = spark.read.parquet(path)
    df = df.where(F.col("set_code") == set_code) if set_code else df
    return df.where(F.col("finish_group") == finish_group) if finish_group else df


def indexed_sets(spark: SparkSession, path: str, finish_group: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("finish_group") == finish_group).select("set_code").distinct().orderBy("set_code")


def vector_from_bytes(content):
    """A float32 little-endian blob as an array, in SQL functions only (for imports of stored blobs)."""
    n = F.octet_length(content) / 4
    word = lambda i: F.conv(F.concat(*[F.hex(F.substring(content, i * 4 + k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("bigint")
    sign = lambda b: F.when(F.shiftright(b, 31) == 1, -1.0).otherwise(1.0)
    exponent = lambda b: F.shiftright(b, 23).bitwiseAND(F.lit(255))
    mantissa = lambda b: b.bitwiseAND(F.lit((1 << 23) - 1))
    value = lambda b: sign(b) * F.when(exponent(b) == 0, mantissa(b) * F.lit(2.0**-149)).otherwise((1 + mantissa(b) / float(1 << 23)) * F.pow(F.lit(2.0), exponent(b) - 127))
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: value(word(i)).cast("float"))
