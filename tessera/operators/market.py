"""Marketplace rows: consolidation of display cards and enrichment by SKUs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import decide

# Fixed output values.
PRODUCT_TYPE = "mtg_single"
LANGUAGE = "ENGLISH"
CONDITION = "NM"


def consolidate(shown: DataFrame, ordinal: str) -> DataFrame:
    """Rows of equal (set_code, collector_number, finish code, name) -> quantity, with the raw finish, source id and
    variant of the first by ordinal, and that ordinal as `first_ord`."""
    first = lambda c: F.min_by(c, ordinal).alias(c)
    keyed = shown.withColumn("finish_code", decide.market_finish(F.col("finish")))
    return keyed.groupBy("set_code", "collector_number", "finish_code", "name").agg(F.count("*").alias("quantity"), first("finish"), first("source_id"), first("variant_type"), F.min(ordinal).alias("first_ord"))


def enrich(rows: DataFrame, skus: DataFrame, ordinal: str = "sku_ord") -> DataFrame:
    """The ten marketplace columns; each row takes the first SKU of its source id that fits its finish, if there is one.

    skus: source_id, product_id, price, condition_short, sku_finish, language, sku_ord.
    """
    s = skus.withColumnRenamed("language", "sku_language")
    pairs = rows.select("source_id", "finish").distinct().join(s, "source_id").where(decide.sku_fits(F.col("sku_finish"), F.col("finish")))
    w = Window.partitionBy("source_id", "finish").orderBy(ordinal)
    best = pairs.withColumn("n", F.row_number().over(w)).where("n = 1").select("source_id", "finish", "product_id", "price", "condition_short", "sku_language")
    out = rows.join(best, ["source_id", "finish"], "left")
    return out.select(
        F.lit(PRODUCT_TYPE).alias("product_type"), decide.or_default(F.col("product_id").cast("string"), "").alias("product_id"), "name", "set_code", "collector_number",
        decide.or_default(F.col("sku_language"), LANGUAGE).alias("language"), F.col("finish_code").alias("finish"), decide.or_default(F.col("condition_short"), CONDITION).alias("condition"),
        F.coalesce(F.col("price").cast("string"), F.lit("")).alias("price"), "quantity", "first_ord",
    )


def _constant(word: str) -> Column:
    known = {"null": None, "true": True, "false": False}
    if word.lower() not in known:
        raise ValueError(f"is takes null, true or false, not {word}")
    return F.lit(known[word.lower()])


def sku_filter(skus: DataFrame, params: dict[str, str]) -> DataFrame:
    """The SKU list's filter grammar: column=op.value with eq, neq, gt, gte, lt, lte, in, like, ilike, is and not.is
    (the last two with the value null, true or false);
    select, order (column.asc or .desc), limit (1000 at most) and offset."""
    out = skus
    for name, text in params.items():
        if name in ("select", "order", "limit", "offset"):
            continue
        op, _, value = text.partition(".")
        if op == "not":
            op, value = "not." + value.partition(".")[0], value.partition(".")[2]
        c = F.col(name)
        tests = {
            "eq": lambda: c == value, "neq": lambda: c != value, "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value,
            "in": lambda: c.isin([v.strip() for v in value.strip("()").split(",")]), "like": lambda: c.like(value.replace("*", "%")), "ilike": lambda: c.ilike(value.replace("*", "%")),
            "is": lambda: c.eqNullSafe(_constant(value)), "not.is": lambda: ~c.eqNullSafe(_constant(value)),
        }
        if op not in tests:
            raise ValueError(f"unknown operator {op}")
        out = out.where(tests[op]())
    if order := params.get("order"):
        keys = [k.partition(".") for k in order.split(",")]
        out = out.orderBy(*[F.desc(k) if d == "desc" else F.asc(k) for k, _, d in keys])
    out = out.offset(int(params.get("offset", 0))).limit(min(1000, int(params.get("limit", 1000))))
    return out.select(*[c.strip() for c in params["select"].split(",")]) if params.get("select") else out
