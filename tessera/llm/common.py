"""What the operators of this subpackage share: lineage cuts, name-safe columns and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: blank, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written rows: later stages survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Of the Parquet files that hold texts: what a writer keeps in memory, and a reader of one group after it, in each task.
ROW_GROUP_BYTES = 16 << 20


def bounded_groups(spark: SparkSession) -> None:
    """From now on this session writes Parquet in groups of ROW_GROUP_BYTES, unless it names a size itself."""
    key = "parquet.block.size"
    if spark.conf.get(key, None) is None and spark.sparkContext._jsc.hadoopConfiguration().get(key) is None:
        spark.conf.set(key, str(ROW_GROUP_BYTES))


#: What a null doc_id reads as.
NO_ID = -(1 << 63)


def id_of(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) and the key alone; columns of other names cannot clash later. Null texts read as empty ones, null ids as NO_ID."""
    return docs.select(id_of(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *key)


#: 128 bits of all columns of a row: rows of equal keys are equal, whatever their ids.
ROW = ("__row0", "__row1")


def with_row(docs: DataFrame) -> DataFrame:
    """docs with the columns ROW. Hashes skip nulls, so which columns are null is hashed as well."""
    cells = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return docs.select("*", *[F.xxhash64(F.lit(i), *cells).alias(k) for i, k in enumerate(ROW)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    edges: (a, b) longs. Returns (node, root): each node that has an edge to another one, with the smallest node of its
    component; the root itself is left out. Every round writes its edges, so that lineage stays short, and joins the
    written minima, so that AQE can split the edges of a hub. Self-loops and repeated edges have no effect; no edges give
    no rows.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


#: Ids of 8 bytes; a broadcast of so many takes about 32 MB.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rows whose doc_id is in ids (one column), which is written first.

    Up to `limit` ids go to the texts; beyond it, Spark joins by shuffle.
    """
    ids = cut(ids.toDF("gone"))
    side = F.broadcast(ids) if ids.count() <= limit else ids
    return docs.join(side, id_of() == F.col("gone"), "left_anti")


def _by_row(docs: DataFrame, rows: DataFrame, how: str, limit: int) -> DataFrame:
    return docs.join(F.broadcast(rows) if rows.count() <= limit else rows, list(ROW), how)


def kept_rows(docs: DataFrame, verdicts: DataFrame, single: bool, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of docs that verdicts keeps, without ROW; docs: with ROW; verdicts: ROW and kept, one row per row of docs.

    Ids play no part: rows stay apart wherever any column differs. Rows of one key are equal and share a verdict; with
    `single`, one of them stays. Up to `limit` keys go to the texts; beyond it, Spark joins by shuffle.
    """
    columns = [c for c in docs.columns if c not in ROW]
    keys = cut(verdicts.groupBy(*ROW).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")) if single else cut(verdicts.where("NOT kept").select(*ROW, "kept").distinct())
    left = _by_row(docs, keys.select(*ROW), "left_anti", limit).select(*columns)
    twice = keys.where("kept").select(*ROW)
    if not single or twice.isEmpty():
        return left
    whole = F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("whole")
    return left.unionByName(_by_row(docs, twice, "left_semi", limit).groupBy(*ROW).agg(whole).select("whole.*"))
