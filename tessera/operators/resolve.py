"""Entity resolution from text: fuzzy set codes, evidence against candidates, triangulation against the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.functions import text as T


def fuzzy_codes(raw: DataFrame, codes: DataFrame, most: int = CONFIG.edit_distance) -> DataFrame:
    """raw (key, code) with set_code and level: 0 exact, 1 substitution, 2 edit distance; no row where nothing fits.

    Exact and substituted codes meet by equality. For edits, both sides give their deletion variants: strings within
    distance 1 share one, so edits meet by equality as well, and a check of the distance follows.
    """
    if most != 1:
        raise ValueError("edits are joined by single deletions; most must be 1")
    raw = raw.withColumn("code", F.upper(F.trim("code"))).where("code <> ''")
    known = codes.select(F.col(codes.columns[0]).alias("set_code")).distinct()
    tries = raw.select("key", "code", F.explode(T.substitutions(F.col("code"))).alias("v")).select("key", "code", F.col("v.ord").alias("ord"), F.col("v.variant").alias("set_code"))
    by_swap = tries.join(known, "set_code").select("key", "code", "set_code", F.when(F.col("ord") == 0, 0).otherwise(1).alias("level"), "ord")

    def deletions(c):
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(c.substr(F.lit(1), i - 1), c.substr(i + 1, F.length(c))))
        return F.array_distinct(F.concat(F.array(c), cut))

    near = raw.select("key", "code", F.explode(deletions(F.col("code"))).alias("part")).join(known.select("set_code", F.explode(deletions(F.col("set_code"))).alias("part")), "part")
    near = near.where(F.levenshtein("code", "set_code") <= most).select("key", "code", "set_code", F.lit(2).alias("level"), F.levenshtein("code", "set_code").alias("ord"))
    w = Window.partitionBy("key", "code").orderBy("level", "ord", "set_code")
    return by_swap.unionByName(near).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "ord")


def code_in_text(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """rows (key, text) -> key, set_code: the first token that fits a known code; no row where none does."""
    tokens = rows.select("key", F.posexplode(T.code_tokens(F.col("text"))).alias("pos", "code"))
    found = fuzzy_codes(tokens.select(F.struct("key", "pos").alias("key"), "code"), codes)
    return found.select("key.*", "set_code").groupBy("key").agg(F.min_by("set_code", "pos").alias("set_code"))


def evidence(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, card_id, level of the candidates that text supports, at the best level of each query.

    lines: query_id, title, set_code, number; candidates: query_id, card_id, card_name, card_set, card_number. Level 1
    is set and number, 2 the number, 3 a title that contains the name or the other way round.
    """
    number = F.lower("card_number") == F.lower("number")
    level = F.when(number & (F.upper("card_set") == F.upper("set_code")), 1).when(number, 2).when(T.title_contained(F.col("title"), F.col("card_name")), 3)
    got = candidates.join(lines, "query_id").withColumn("level", level).where("level IS NOT NULL")
    best = F.min("level").over(Window.partitionBy("query_id"))
    return got.withColumn("best", best).where("level = best").select("query_id", "card_id", "level")


def triangulate(lines: DataFrame, catalogue: DataFrame, order: str = "card_id") -> DataFrame:
    """query_id, card_id, level: the first catalogue card by 1 set and number, 2 set and title, 3 set and first word of
    the title, 4 number and title, all in the line's finish.

    lines: query_id, title, set_code, number, finish; catalogue: card_id, name, set_code, number, finish. Each level is
    a join on equal keys with the catalogue's first card of each key, so that a common word or title gives a line one
    row and not one a card; the smallest level and then the catalogue's order win. Lines of one query_id count together.
    """
    q = lines.select("query_id", F.lower(F.trim("title")).alias("t"), F.upper("set_code").alias("s"), F.lower("number").alias("n"), F.lower("finish").alias("f"), T.first_word(F.col("title")).alias("w"))
    c = catalogue.select("card_id", F.col(order).alias("o"), F.lower("name").alias("t"), F.upper("set_code").alias("s"), F.lower("number").alias("n"), F.lower("finish").alias("f"), T.first_word(F.col("name")).alias("w"))
    levels = [(1, ["s", "n"]), (2, ["s", "t"]), (3, ["s", "w"]), (4, ["n", "t"])]
    found = None
    for level, keys in levels:
        left = q.where(F.length("w") > 3) if level == 3 else q.where(F.length("t") > 0) if "t" in keys else q
        firsts = c.groupBy("f", *keys).agg(F.min(F.struct("o", "card_id")).alias("first"))
        hit = left.select("query_id", "f", *keys).join(firsts, ["f", *keys])
        hit = hit.groupBy("query_id").agg(F.min("first").alias("first")).select("query_id", F.lit(level).alias("level"), F.col("first.card_id").alias("card_id"))
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy("query_id").agg(F.min_by("card_id", "level").alias("card_id"), F.min("level").alias("level"))
