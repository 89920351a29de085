"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting white space. Round one scans each text once and keeps only its normalised
length and the hash of its first characters; groups of one are settled. Round two hashes the full content of the texts
in groups that are left. Text is never shuffled: the surviving (length, prefix) keys go to the texts while their number
is within `broadcast_groups`, and beyond that every text is hashed where it is read. All grouping is by partial
aggregation over narrow rows, and the join back is between two written tables, so AQE can split the rows of a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, documents, texts

PREFIX_CHARS = 64
#: Keys of 16 bytes; at this many a broadcast stays under about 50 MB.
BROADCAST_GROUPS = 500_000


def _normalised(docs: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, key, chars, norm, len and prefix of each row."""
    flat = texts(docs, key=key).select("doc_id", *key, F.length("text").alias("chars"), F.regexp_replace("text", SPACE, "").alias("norm"))
    return flat.select("*", F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))


def exact_dedup(docs: DataFrame, digest_all: bool = False, broadcast_groups: int = BROADCAST_GROUPS, key: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, key (columns of docs), keep_id, group_size, kept, text_sha256.

    The row with the most code points in the original text, then the smallest doc_id, stays; of rows that tie in both,
    repeated rows and rows with a null doc_id (it reads as the smallest one) among them, one stays, with a key the one of
    the greatest key. Null text counts as empty, empty texts are equal to each other, an empty table gives no rows; texts
    of any length are read whole. text_sha256 is null where no full hash was needed, unless digest_all.
    """
    sketch = _normalised(docs).select("len", "prefix")
    keys = cut(sketch.groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("len", "prefix"))
    rows = _normalised(docs, key)
    if keys.count() <= broadcast_groups:
        rows = rows.join(F.broadcast(keys.withColumn("open", F.lit(True))), ["len", "prefix"], "left")
    else:
        rows = rows.withColumn("open", F.lit(True))
    full = F.sha2(F.col("norm").cast("binary"), 256)
    rows = rows.select("doc_id", *key, "chars", "len", "prefix", F.coalesce("open", F.lit(False)).alias("open"), (full if digest_all else F.when(F.col("open"), full)).alias("text_sha256"))
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()))  # a row's place in the written table
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("last"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(key)], "at")).alias("best")
    groups = rows.where("open").groupBy("len", "text_sha256").agg(F.count("*").alias("group_size"), best).where("group_size > 1")
    groups = cut(groups.select("len", "text_sha256", "group_size", F.bitwise_not("best.last").alias("keep_id"), F.col("best.at").alias("keep_at")))
    out = rows.join(groups, ["len", "text_sha256"], "left")
    return out.select(
        "doc_id",
        *key,
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep_at").isNull() | (F.col("keep_at") == F.col("at"))).alias("kept"),
        "text_sha256",
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), digest_all=True)


OP9_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
