"""Queries over lookups, and over files that writers write and readers read, with their oracle SQL.

A file query writes its sample under the session's shared folder, a new one each time, and reads it back.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.operators import batch, catalog, lookup
from tessera.sources import files, sinks

from . import standins as S

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def folder(spark) -> str:
    """A new folder that driver and executors share; only a local session may use one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root}/tessera-files-{uuid.uuid4().hex}"


# ---- lookups ----


def _variants(v):
    low = lambda n: F.col("hash").bitwiseAND(F.lit((1 << n) - 1))
    kinds = F.array(*[F.struct(F.lit(k).alias("variant_type"), h.alias("hash")) for k, h in (("full", F.col("hash")), ("name", low(48)), ("collector", low(16)))])
    return v.select("card_id", F.explode(kinds).alias("k")).select("card_id", "k.*")


def _search_sql(mask: str, where: str, most: int, n: int) -> str:
    return f"""WITH {S.VECTORS_SQL}, {S.CARDS_SQL}, s AS (SELECT q.card_id AS query_id, c.card_id, c.name, c.set_code, c.finish, CAST(bit_count(xor(q.h & {mask}, x.h & {mask})) AS BIGINT) AS distance
FROM e q, e x JOIN cards c ON c.card_id = x.card_id WHERE q.card_id % {S.EVERY} = 0 AND {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, card_id) AS rank FROM s WHERE distance <= {most})
SELECT query_id, CAST(rank AS INTEGER) AS rank, distance, card_id, name, set_code, finish FROM r WHERE rank <= {n}"""


_SHOWN = ["query_id", "rank", "distance", "card_id", "name", "set_code", "finish"]


@query(_search_sql("18446744073709551615", "c.finish = 'foil' AND c.set_code = 'BRAND11'", 34, 5))
def hash_search_in_set(spark, d):
    """By the whole hash, within one set and finish; top_n counts cards of that part."""
    v = S.vectors(spark, d)
    return lookup.hash_search(S.queries(v).select("query_id", "hash"), S.cards(spark, d), _variants(v), "full", "brand11", "foil", 34, 5).select(*_SHOWN)


@query(_search_sql("281474976710655", "true", 24, 10))
def hash_search_by_variant(spark, d):
    """By the hash of one variant, in the whole catalogue."""
    v = S.vectors(spark, d)
    low = F.col("hash").bitwiseAND(F.lit((1 << 48) - 1)).alias("hash")
    return lookup.hash_search(S.queries(v).select("query_id", low), S.cards(spark, d), _variants(v), "name", most=24, top_n=10).select(*_SHOWN)


@query(f"WITH {S.VECTORS_SQL}, {S.CARDS_SQL} SELECT c.card_id, t.variant_type, lpad(lower(to_hex(CASE t.variant_type WHEN 'full' THEN e.h WHEN 'name' THEN e.h & 281474976710655 ELSE e.h & 65535 END)), 16, '0') AS hash FROM cards c JOIN e ON e.card_id = c.card_id, (VALUES ('full'), ('name'), ('collector')) t(variant_type)")
def hash_variants_of_cards(spark, d):
    from tessera.functions.hashing import hash_to_hex

    return lookup.variants_of(S.cards(spark, d), _variants(S.vectors(spark, d))).select("card_id", "variant_type", hash_to_hex(F.col("hash")).alias("hash"))


_CANDIDATES = "SELECT l_orderkey AS query_id, l_partkey AS card_id, max(round(0.5 + l_discount * 6, 4)) AS score, l_partkey % 3 > 0 AS valid FROM lineitem GROUP BY l_orderkey, l_partkey"


@query(
    f"""WITH c AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS n FROM c WHERE valid),
b AS (SELECT query_id, max(CASE WHEN n = 1 THEN card_id END) AS id, max(CASE WHEN n = 1 THEN score END) AS s1, max(CASE WHEN n = 2 THEN score END) AS s2, max(CASE WHEN n = 3 THEN score END) AS s3 FROM r GROUP BY query_id),
s AS (SELECT o_orderkey AS query_id, o_orderkey % 11 = 0 AS failed FROM orders UNION ALL SELECT -1 - o_orderkey, false FROM orders WHERE o_orderkey % 13 = 0),
j AS (SELECT s.*, b.*  EXCLUDE (query_id), EXISTS (SELECT 1 FROM c WHERE c.query_id = s.query_id) AS found FROM s LEFT JOIN b ON b.query_id = s.query_id),
a AS (SELECT *, CASE WHEN s2 IS NULL THEN false WHEN s3 IS NOT NULL THEN s1 - s3 < {CONFIG.clarity_threshold} ELSE s1 - s2 < {CONFIG.clarity_threshold} END AS amb, NOT failed AND s1 IS NOT NULL AS ok FROM j)
SELECT query_id, CASE WHEN ok THEN id END AS match_card_id, CAST(CASE WHEN ok THEN s1 ELSE 0.0 END AS DOUBLE) AS confidence, CAST(CASE WHEN ok THEN CASE WHEN s2 IS NULL THEN 1.0 ELSE s1 - s2 END END AS DOUBLE) AS clarity,
CASE WHEN failed THEN 'error' WHEN NOT found THEN 'no_candidates' WHEN s1 IS NULL THEN 'no_valid_candidates' WHEN s1 >= {CONFIG.accept_threshold} AND amb THEN 'ambiguous_high' WHEN s1 >= {CONFIG.accept_threshold} THEN 'auto_accept' ELSE 'manual_review' END AS decision FROM a"""
)
def match_outcomes(spark, d):
    """Every scan has its row: errors, no candidates, no valid ones, and decided ones."""
    li, o = S.read(spark, d, "lineitem"), S.read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"))
    scans = o.select("query_id", F.when(F.col("query_id") % 11 == 0, "unreadable").alias("error"))
    scans = scans.unionByName(o.where("query_id % 13 = 0").select((-1 - F.col("query_id")).alias("query_id"), F.lit(None).cast("string").alias("error")))
    c = li.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("card_id")).agg(F.max(F.round(0.5 + F.col("l_discount") * 6, 4)).alias("score"))
    return lookup.outcomes(scans, c.withColumn("valid", F.col("card_id") % 3 > 0))


_AVAILABLE = f"WITH {S.CARDS_SQL}, a AS (SELECT set_code, finish, count(*) AS images, count(*) FILTER (card_id % 4 = 0) AS indexed FROM cards GROUP BY set_code, finish)"


@query(f"{_AVAILABLE} SELECT set_code, CAST(sum(images) AS BIGINT) AS images, CAST(sum(indexed) AS BIGINT) AS indexed, CAST(sum(images - indexed) AS BIGINT) AS to_process FROM a GROUP BY ROLLUP (set_code)")
def index_totals(spark, d):
    c = S.cards(spark, d)
    return lookup.totals(catalog.availability(c.select("set_code", "finish"), c.where("card_id % 4 = 0").select("set_code", "finish")))


_PATHS = "SELECT CASE p_partkey % 7 WHEN 0 THEN '/img/.cache/foil/' WHEN 1 THEN '/img/loose/' ELSE '/img/' || lower(replace(p_brand, '#', '')) || '/' || CASE p_partkey % 3 WHEN 0 THEN 'foil' WHEN 1 THEN 'nonfoil' ELSE 'etched' END || '/' END || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.txt' ELSE '.jpg' END AS path FROM part"


@query(
    f"""WITH p AS ({_PATHS}), x AS (SELECT DISTINCT upper(regexp_extract(path, '/([^/.][^/]*)/(nonfoil|foil|etched)/[^/]+\\.(jpg|png)$', 1)) AS set_code, regexp_extract(path, '/([^/.][^/]*)/(nonfoil|foil|etched)/[^/]+\\.(jpg|png)$', 2) AS finish FROM p)
SELECT set_code, concat_ws(',', CASE WHEN bool_or(finish = 'nonfoil') THEN 'nonfoil' END, CASE WHEN bool_or(finish = 'foil') THEN 'foil' END, CASE WHEN bool_or(finish = 'etched') THEN 'etched' END) AS finishes FROM x WHERE set_code <> '' GROUP BY set_code"""
)
def discovered_sets(spark, d):
    p = S.read(spark, d, "part")
    k = F.col("p_partkey")
    finish = F.when(k % 3 == 0, "foil").when(k % 3 == 1, "nonfoil").otherwise("etched")
    lead = F.when(k % 7 == 0, "/img/.cache/foil/").when(k % 7 == 1, "/img/loose/").otherwise(F.concat(F.lit("/img/"), F.lower(F.translate("p_brand", "#", "")), F.lit("/"), finish, F.lit("/")))
    paths = p.select(F.concat(lead, k.cast("string"), F.when(k % 5 == 0, ".txt").otherwise(".jpg")).alias("path"))
    return lookup.discovered(paths).select("set_code", F.array_join("finishes", ",").alias("finishes"))


@query("SELECT p_partkey AS card_id, concat_ws('|', upper(replace(p_brand, '#', '')), upper(p_type)) AS sets FROM part")
def parsed_set_list(spark, d):
    text = F.concat(F.lit(" ,"), F.lower(F.translate("p_brand", "#", "")), F.lit(" , ,"), F.col("p_type"), F.lit(","))
    return S.read(spark, d, "part").select(F.col("p_partkey").alias("card_id"), F.array_join(lookup.set_list(text), "|").alias("sets"))


@query(f"WITH {S.CARDS_SQL} SELECT card_id, name, set_code, collector_number, finish FROM cards WHERE set_code = 'BRAND11' AND finish = 'nonfoil' AND collector_number = '1' UNION ALL SELECT card_id, name, set_code, collector_number, finish FROM cards WHERE card_id = 7 UNION ALL (SELECT card_id, name, set_code, collector_number, finish FROM cards WHERE image_path = '/img/9.jpg' ORDER BY card_id LIMIT 1)")
def point_lookups(spark, d):
    """By natural key, by id, and the first match of a path."""
    c = S.cards(spark, d)
    some = batch.select_cards(c, "brand11", "NonFoil", collector_number="1").unionByName(batch.select_cards(c, card_id=7)).unionByName(batch.select_cards(c, image_path="/img/9.jpg", limit=1))
    return some.select("card_id", "name", "set_code", "collector_number", "finish")


# ---- files ----


@query("SELECT '/scan/' || p_partkey || '.jpg' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'old' || p_partkey ELSE 'c' || p_partkey END AS match_id, CAST(CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_size / 100.0 END AS DOUBLE) AS confidence, 0.25::DOUBLE AS seconds, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' || p_partkey || ',b' ELSE 'x' || p_partkey END AS candidates FROM part")
def read_predictions(spark, d):
    """Lists of ids, of objects, broken lists, two names of the match column, numbers that are none."""
    p, k = S.read(spark, d, "part"), F.col("p_partkey").cast("string")
    m = F.col("p_partkey")
    lists = F.when(m % 4 == 0, "[broken").when(m % 4 == 1, F.concat(F.lit('["a'), k, F.lit('", "b"]'))).otherwise(F.concat(F.lit('[{"card_id": "x'), k, F.lit('", "score": 1}]')))
    rows = p.select(F.concat(F.lit("/scan/"), k, F.lit(".jpg")).alias("scanned_path"), F.when(m % 3 != 0, F.concat(F.lit("c"), k)).alias("match_card_id"), F.concat(F.lit("old"), k).alias("matched_card_id"), F.when(m % 5 == 0, "none").otherwise((F.col("p_size") / 100).cast("string")).alias("confidence"), lists.alias("candidates"), F.lit("0.25").alias("processing_time"))
    path = f"{folder(spark)}/predictions"
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return files.predictions(spark, path).withColumn("candidates", F.array_join("candidates", ","))


@query("SELECT '/scan/' || p_partkey || '.jpg' AS path, 'g' || p_size AS gold_id FROM part")
def read_gold(spark, d):
    path = f"{folder(spark)}/gold"
    S.read(spark, d, "part").selectExpr("concat('/scan/', p_partkey, '.jpg') AS scanned_path", "concat('g', p_size) AS correct_card_id").write.option("header", True).csv(path)
    return files.gold(spark, path)


@query(f"WITH {S.CARDS_SQL} SELECT '/scan/' || card_id || '.jpg' AS scanned_path, card_id AS correct_card_id, image_path FROM cards WHERE card_id % 3 = 0")
def read_corrections(spark, d):
    """A corrections file, less the rows whose scan or card is unknown; a file that is not there has none."""
    at, c = folder(spark), S.cards(spark, d)
    k = F.col("card_id")
    rows = c.select(F.concat(F.lit("/scan/"), k.cast("string"), F.lit(".jpg")).alias("scanned_path"), F.when(k % 2 == 0, k).otherwise(k).cast("string").alias("correct_card_id"))
    rows.unionByName(rows.limit(3).withColumn("correct_card_id", F.lit("-5"))).write.option("header", True).csv(f"{at}/corrections")
    scans = c.where("card_id % 3 = 0").select(F.concat(F.lit("/scan/"), k.cast("string"), F.lit(".jpg")).alias("path"))
    read = files.corrections(spark, f"{at}/corrections").unionByName(files.corrections(spark, f"{at}/missing"))
    return catalog.valid_corrections(read.withColumn("correct_card_id", F.col("correct_card_id").cast("long")), scans, c)


@query("SELECT 'f' || s_suppkey || '.jpg' AS file, s_name AS exp_name, 'S' || s_nationkey AS exp_set, CAST(s_suppkey AS VARCHAR) AS exp_number, CAST(0.5 + s_nationkey / 100.0 AS DOUBLE) AS exp_confidence FROM supplier")
def read_expectations(spark, d):
    """Stored expectations: one JSON object of file names."""
    at = f"{folder(spark)}/expected"
    s = S.read(spark, d, "supplier")
    value = F.struct(F.col("s_name").alias("card_name"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("set_code"), F.col("s_suppkey").cast("string").alias("collector_number"), (0.5 + F.col("s_nationkey") / 100.0).cast("double").alias("confidence"))
    whole = s.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit(".jpg")), value)))).alias("value"))
    whole.write.text(at)
    return files.expectations(spark, at)


@query("SELECT 'i' || p_partkey AS id, upper(replace(p_brand, '#', '')) AS set_code, p_partkey % 2 = 0 AS foil, CASE WHEN p_partkey % 3 = 0 THEN 'u' || p_partkey ELSE 'f' || p_partkey END AS large FROM part WHERE p_partkey % 4 > 0")
def read_bulk_items(spark, d):
    """Bulk items a line each, with pictures of their own or of a face; only eligible ones."""
    p, k, at = S.read(spark, d, "part"), F.col("p_partkey").cast("string"), f"{folder(spark)}/bulk"
    m = F.col("p_partkey")
    rows = p.select(F.concat(F.lit("i"), k).alias("id"), F.upper(F.translate("p_brand", "#", "")).alias("set"), F.when(m % 4 == 0, "de").otherwise("en").alias("lang"), F.when(m % 2 == 0, F.array(F.lit("nonfoil"), F.lit("foil"))).otherwise(F.array(F.lit("nonfoil"))).alias("finishes"),
                    F.when(m % 3 == 0, F.struct(F.concat(F.lit("u"), k).alias("large"))).alias("image_uris"), F.when(m % 3 != 0, F.array(F.struct(F.struct(F.concat(F.lit("f"), k).alias("large")).alias("image_uris")))).alias("card_faces"))
    rows.write.json(at)
    return catalog.eligible(files.bulk_items(spark, at)).select("id", F.col("set").alias("set_code"), F.array_contains("finishes", "foil").alias("foil"), "large")


@query("SELECT vec_id AS card_id, 'L' || label AS set_code, len(embedding)::INTEGER AS dim FROM embeddings WHERE label = 3 AND vec_id % 2 = 0 UNION ALL SELECT -1 - row_number() OVER (ORDER BY label), 'L' || label, 0 FROM (SELECT DISTINCT label FROM embeddings WHERE vec_id % 2 = 1)")
def index_files(spark, d):
    """A stored index: one partition of it, and the sets of the other finish group (by number)."""
    from pyspark.sql import Window

    at = f"{folder(spark)}/index"
    v = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("card_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("set_code"), F.when(F.col("vec_id") % 2 == 0, "foil").otherwise("nonfoil").alias("finish_group"), "embedding", "label")
    sinks.write_index(v, at)
    one = files.index(spark, at, "L3", "foil").select(F.col("card_id").cast("long").alias("card_id"), "set_code", F.size("embedding").alias("dim"))
    sets = files.indexed_sets(spark, at, "nonfoil")
    n = F.row_number().over(Window.orderBy(F.substring("set_code", 2, 9).cast("int")))
    return one.unionByName(sets.select((-1 - n).cast("long").alias("card_id"), "set_code", F.lit(0).alias("dim")))


@query(f"WITH {S.CARDS_SQL} SELECT card_id, name, set_code, finish FROM cards")
def export_files(spark, d):
    """A CSV export read back, names with quotes and commas kept, joined with the JSON export of the same rows."""
    at, c = folder(spark), S.cards(spark, d).select("card_id", "name", "set_code", "finish")
    marked = c.withColumn("name", F.concat(F.lit('"a, '), F.col("name"), F.lit('"')))
    sinks.write_csv(marked, f"{at}/csv")
    sinks.write_json(c, f"{at}/json")
    csv = spark.read.option("header", True).schema("card_id long, name string, set_code string, finish string").option("escape", "\\").csv(f"{at}/csv")
    back = csv.select("card_id", F.regexp_extract("name", '^"a, (.*)"$', 1).alias("name"))
    return back.join(spark.read.schema("card_id long, name string, set_code string, finish string").json(f"{at}/json"), ["card_id", "name"])
