"""Hash search within parts of the catalogue, ranked fetches, outcomes of a match batch, and discovery of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.functions import decide

from .batch import select_cards
from .retrieve import hamming_search

FINISHES = ("nonfoil", "foil", "etched")


def ranked_fetch(ranked: DataFrame, cards: DataFrame) -> DataFrame:
    """The cards that ranked (query_id, card_id, rank, ...) names, each with its rank; cards that are gone are left out."""
    return ranked.join(cards, "card_id")


def hash_search(queries: DataFrame, cards: DataFrame, variants: DataFrame, variant_type: str = "full", set_code: str | None = None, finish: str | None = None, most: int = CONFIG.max_hamming, top_n: int | None = CONFIG.hamming_top_n) -> DataFrame:
    """query_id, rank, distance and the columns of the cards whose hash of one variant is near a query's.

    queries: query_id, hash; variants: card_id, variant_type, hash. Set and finish are filtered before the search, so
    that top_n counts cards of that part only; a card without such a variant, or with a null hash, is never found.
    """
    some = select_cards(cards, set_code, finish)
    index = variants.where((F.col("variant_type") == variant_type) & F.col("hash").isNotNull()).join(some.select("card_id"), "card_id", "left_semi")
    return ranked_fetch(hamming_search(queries, index, most, top_n), some)


def variants_of(cards: DataFrame, variants: DataFrame) -> DataFrame:
    """One row a card and hash variant that it has."""
    return cards.select("card_id").join(variants, "card_id")


def outcomes(scans: DataFrame, candidates: DataFrame, config=CONFIG) -> DataFrame:
    """One row per scan: query_id, match_card_id, confidence, clarity, decision.

    scans: query_id, error (null if the picture was read); candidates: query_id, card_id, score, valid (false: the index
    knows the vector, the catalogue no longer the card). A scan that failed is an error; one without candidates, or
    without valid ones, says so and has a confidence of 0; all others are decided by their best three scores.
    """
    row = F.row_number().over(Window.partitionBy("query_id", "valid").orderBy(F.desc("score"), "card_id"))
    few = candidates.select("query_id", "valid", F.struct((-F.col("score")).alias("s"), "card_id").alias("c"), row.alias("n")).where("n <= 3")
    best = few.groupBy("query_id").agg(F.count("*").alias("found"), F.sort_array(F.collect_list(F.when(F.col("valid"), F.col("c")))).alias("best"))
    both = scans.join(best, "query_id", "left")
    score = lambda i: -F.get("best", F.lit(i))["s"]
    top, second, third = score(0), score(1), score(2)
    usual = decide.decision(top, decide.ambiguous(top, second, third, config), F.lit(False), config)
    how = F.when(F.col("error").isNotNull(), "error").when(F.col("found").isNull(), "no_candidates").when(top.isNull(), "no_valid_candidates").otherwise(usual)
    ok = F.col("error").isNull() & top.isNotNull()
    return both.select(
        "query_id",
        F.when(ok, F.get("best", F.lit(0))["card_id"]).alias("match_card_id"),
        F.when(ok, top).otherwise(0.0).alias("confidence"),
        F.when(ok, decide.clarity(top, second)).alias("clarity"),
        how.alias("decision"),
    )


def totals(per_set: DataFrame) -> DataFrame:
    """set_code, images, indexed, to_process of each set, and of all sets under a null set_code."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("images", "indexed", "to_process")]
    return per_set.rollup("set_code").agg(*sums)


def sets_of_paths(path: Column) -> tuple[Column, Column]:
    """Set (upper case) and finish of <root>/<set>/<finish>/<file>; nulls for other paths and for hidden folders."""
    pattern = r"(?i)/([^/.][^/]*)/(" + "|".join(FINISHES) + r")/[^/]+\.(?:jpg|png)$"
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit(""))
    return F.upper(part(1)), F.lower(part(2))


def discovered(paths: DataFrame) -> DataFrame:
    """set_code and the finishes that it has pictures of, in the usual order; paths: path."""
    set_code, finish = sets_of_paths(F.col("path"))
    found = paths.select(set_code.alias("set_code"), finish.alias("finish")).where("set_code IS NOT NULL").distinct()
    order = F.array(*map(F.lit, FINISHES))
    return found.groupBy("set_code").agg(F.array_intersect(order, F.collect_set("finish")).alias("finishes"))


def set_list(text: Column) -> Column:
    """The sets of a comma-separated list: trimmed, upper case, blanks dropped; an empty list for null."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: x != "")
