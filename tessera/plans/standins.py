"""The benchmark tables read as the engine's relations.

embeddings is the vector index (label stands for the set), part the cards, orders the batches, lineitem the batch
results, supplier the SKUs, events the source items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import median_bits
from tessera.operators.retrieve import spread

EVERY = 10


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark, d) -> DataFrame:
    """card_id, label, embedding, hash."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("card_id"), "label", "embedding")
    return spread(e).withColumn("hash", median_bits(F.col("embedding")))


def queries(v: DataFrame) -> DataFrame:
    return v.where(f"card_id % {EVERY} = 0").withColumnRenamed("card_id", "query_id")


def hashes(v: DataFrame) -> DataFrame:
    """card_id, full, name, collector: the hash, its low 48 and its low 16 bits."""
    low = lambda n: F.col("hash").bitwiseAND(F.lit((1 << n) - 1))
    return v.select("card_id", F.col("hash").alias("full"), low(48).alias("name"), low(16).alias("collector"))


def cards(spark, d) -> DataFrame:
    """p_type is given as finish in the market's words: ECONOMY and SMALL etched, PROMO and LARGE foil, others nonfoil."""
    p = read(spark, d, "part")
    finish = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "etched").when(F.col("p_type").isin("PROMO", "LARGE"), "foil").otherwise("nonfoil")
    return p.select(
        F.col("p_partkey").alias("card_id"), F.col("p_name").alias("name"), F.upper(F.translate("p_brand", "#", "")).alias("set_code"), F.col("p_size").cast("string").alias("collector_number"), finish.alias("finish"),
        F.concat(F.lit("s"), (F.col("p_partkey") % 97).cast("string")).alias("source_id"), F.lit("normal").alias("variant_type"), F.concat(F.lit("/img/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image_path"),
    )


CARDS_SQL = """cards AS (SELECT p_partkey AS card_id, p_name AS name, upper(replace(p_brand, '#', '')) AS set_code, CAST(p_size AS VARCHAR) AS collector_number,
 CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'etched' WHEN p_type IN ('PROMO', 'LARGE') THEN 'foil' ELSE 'nonfoil' END AS finish,
 's' || CAST(p_partkey % 97 AS VARCHAR) AS source_id, 'normal' AS variant_type, '/img/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image_path FROM part)"""


def results(spark, d) -> DataFrame:
    """lineitem as results; R rows are corrected, confidence comes from the discount, clarity from the tax."""
    li = read(spark, d, "lineitem")
    r = F.col("l_returnflag") == "R"
    return li.select(
        F.col("l_orderkey").alias("batch_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("image_filename"), F.col("l_partkey").alias("matched_card_id"), F.round(0.5 + F.col("l_discount") * 6, 4).alias("confidence"),
        F.round(F.col("l_tax") * 10, 4).alias("clarity_score"), r.alias("is_corrected"), F.when(r, F.col("l_suppkey")).alias("corrected_card_id"), F.when(r, F.col("l_linestatus")).alias("correction_reason"), F.col("l_quantity").alias("bytes"), "l_linenumber",
    )


RESULTS_SQL = """results AS (SELECT l_orderkey AS batch_id, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS image_filename, l_partkey AS matched_card_id, round(0.5 + l_discount * 6, 4) AS confidence,
 round(l_tax * 10, 4) AS clarity_score, l_returnflag = 'R' AS is_corrected, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS corrected_card_id, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS correction_reason, l_quantity AS bytes, l_linenumber FROM lineitem)"""


def batches(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS")).alias("completed_at"), (F.pmod("o_orderkey", F.lit(9)) + 1).alias("total"))


BATCHES_SQL = """batches AS (SELECT o_orderkey AS batch_id, o_orderstatus AS status, o_orderdate AS created_at, o_orderkey % 9 + 1 AS total FROM orders)"""

VECTORS_SQL = """e0 AS (SELECT vec_id AS card_id, label, embedding::DOUBLE[] AS v, list_median(embedding::DOUBLE[]) AS m FROM embeddings),
e AS (SELECT card_id, label, v, list_sum(list_transform(range(64), lambda i: CASE WHEN v[i + 1] > m THEN (1::HUGEINT << (63 - i)::INTEGER) ELSE 0::HUGEINT END))::HUGEINT AS h FROM e0)"""


