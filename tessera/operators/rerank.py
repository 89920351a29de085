"""Staged reranking of candidates: hash fusion, keypoints, clarity, text evidence, decision.

All stages work on rows (query_id, card_id, score, rank, ...) and share one partitioning by query_id, so the windows
need a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.functions import decide
from tessera.functions.hashing import combine_distances, hamming


def per_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def reranked(rows: DataFrame, *tie: str) -> DataFrame:
    """rows with rank by falling score; ties by the columns in tie (rank and card_id if none)."""
    order = [F.desc("score"), *[F.col(c) for c in tie or ("rank", "card_id")]]
    return rows.withColumn("rank", F.row_number().over(per_query().orderBy(*order)))


def fuse_hashes(rows: DataFrame, hashes: DataFrame, config=CONFIG) -> DataFrame:
    """Scores fused with hash similarity and ranked anew; hashes: card_id, full, name, collector.

    Candidates without a row in hashes are dropped, as are candidates of queries without one; a null variant counts as
    the largest distance.
    """
    own = hashes.select(F.col("card_id").alias("query_id"), F.col("full").alias("q_full"), F.col("name").alias("q_name"), F.col("collector").alias("q_collector"))
    both = rows.join(hashes, "card_id").join(own, "query_id")
    d = {v: hamming(F.col(v), F.col(f"q_{v}")) for v in ("full", "name", "collector")}
    scored = both.select("query_id", "card_id", "rank", F.col("score").alias("embedding_score"), combine_distances(d["full"], d["name"], d["collector"], config).alias("hash_score"))
    return reranked(scored.withColumn("score", decide.fused_score(F.col("embedding_score"), F.col("hash_score"), config)))


def keypoints(rows: DataFrame, similarity: Column, config=CONFIG) -> DataFrame:
    """Keypoint bands on the first candidates; with resort_on_boost_only, a query is ranked anew only if one was boosted."""
    near = F.when(F.col("rank") <= config.keypoint_depth, similarity)
    out = rows.withColumn("similarity", near).withColumn("boosted", decide.keypoint_boosted(F.col("similarity"), config))
    out = out.withColumn("score", decide.keypoint_score(F.col("score"), F.col("similarity"), config))
    new = F.row_number().over(per_query().orderBy(F.desc("score"), "rank"))
    if config.resort_on_boost_only:
        new = F.when(F.max("boosted").over(per_query()), new).otherwise(F.col("rank"))
    return out.withColumn("rank", new).drop("similarity", "boosted")


def top_scores(rows: DataFrame) -> DataFrame:
    """One row a query: the scores of ranks 1 to 3, the first card and whether it was injected."""
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    injected = at(1, "injected") if "injected" in rows.columns else F.lit(False)
    return rows.groupBy("query_id").agg(at(1, "score").alias("s1"), at(2, "score").alias("s2"), at(3, "score").alias("s3"), at(1, "card_id").alias("match_card_id"), injected.alias("injected"))


def decisions(rows: DataFrame, config=CONFIG) -> DataFrame:
    """One row a query: match_card_id, confidence, clarity, is_ambiguous, decision."""
    top = top_scores(rows)
    unclear = decide.ambiguous(F.col("s1"), F.col("s2"), F.col("s3"), config)
    return top.select(
        "query_id",
        "match_card_id",
        F.col("s1").alias("confidence"),
        decide.clarity(F.col("s1"), F.col("s2")).alias("clarity"),
        unclear.alias("is_ambiguous"),
        decide.decision(F.col("s1"), unclear, F.col("injected"), config).alias("decision"),
    )


def gated(rows: DataFrame, config=CONFIG) -> DataFrame:
    """rows with `gate`: whether the query goes to text evidence, because it is ambiguous or its top score is low."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score"))).over(per_query())
    unclear = decide.ambiguous(F.col("_1"), F.col("_2"), F.col("_3"), config)
    return rows.withColumns({"_1": at(1), "_2": at(2), "_3": at(3)}).withColumn("gate", decide.ocr_gate(F.col("_1"), unclear, config)).drop("_1", "_2", "_3")


def boost_matched(rows: DataFrame, matched: Column, config=CONFIG) -> DataFrame:
    """Boost the rows that text evidence matched, in gated queries, and rank anew."""
    hit = F.col("gate") & F.coalesce(matched, F.lit(False))
    return reranked(rows.withColumn("score", F.when(hit, decide.boosted(F.col("score"), config.ocr_boost)).otherwise(F.col("score"))))


def inject(rows: DataFrame, found: DataFrame, config=CONFIG) -> DataFrame:
    """Add or boost the triangulated card of each query; found: query_id, card_id.

    A card among the candidates gets twice the boost; another one comes in front with a fixed score and wins ties.
    """
    mark = found.select("query_id", "card_id", F.lit(True).alias("hit"))
    old = rows.join(mark, ["query_id", "card_id"], "left").withColumn("injected", F.lit(False))
    old = old.withColumn("score", F.when(F.col("hit"), decide.boosted(F.col("score"), 2 * config.ocr_boost)).otherwise(F.col("score"))).drop("hit")
    new = found.join(rows.select("query_id", "card_id"), ["query_id", "card_id"], "left_anti")
    new = new.select("query_id", "card_id", F.lit(config.triangulated_score).alias("score"), F.lit(0).alias("rank"), F.lit(True).alias("injected"))
    return reranked(old.unionByName(new, allowMissingColumns=True))


def best_over(rows: DataFrame, set_col: str) -> DataFrame:
    """For each query the best-scoring first candidate over sets; the first set in order wins ties."""
    w = per_query().orderBy(F.desc("score"), set_col, "card_id")
    return rows.where("rank = 1").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def prefer_finish(foil: DataFrame, plain: DataFrame, config=CONFIG) -> DataFrame:
    """foil if it is accepted, else plain if there is one, else the low foil; both: query_id, card_id, score."""
    f = foil.select("query_id", F.struct("score", "card_id", F.lit("foil").alias("finish")).alias("f"))
    p = plain.select("query_id", F.struct("score", "card_id", F.lit("nonfoil").alias("finish")).alias("p"))
    take = F.coalesce(F.when(F.col("f.score") >= config.accept_threshold, F.col("f")), F.col("p"), F.col("f"))
    return f.join(p, "query_id", "full").select("query_id", take["card_id"].alias("card_id"), take["score"].alias("score"), take["finish"].alias("finish"))
