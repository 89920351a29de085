"""Similarity search: stated queries against a whole index.

Queries go out in blocks of a fixed number of vectors, so what is broadcast has a bound whatever their number; each
task keeps the best of its part of the index, and a window with a partial group limit ranks what is left.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.functions.hashing import hamming

#: Vectors in one broadcast block: 4096 x 512 doubles are 16 MB.
BLOCK_QUERIES = 4096
RESULT = "query_id long, card_id long, score double"
#: Scores held at once (doubles, 16 MB), and the decimals that they are told apart by: equal vectors, summed in another
#: order, tie.
CELLS = 2_000_000
DECIMALS = 12


def blocks(queries: DataFrame, size: int):
    """(ids, matrix, partition keys) of up to size queries at a time, in id order, streamed to the driver."""
    held = []
    for r in queries.orderBy("query_id").toLocalIterator(prefetchPartitions=False):
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        d = (q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1)[None, :]
        return 1.0 / (1.0 + np.maximum(d, 0.0))
    dots = q @ x.T
    if metric == "inner":
        return dots
    long = np.outer(np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)))
    cos = np.divide(dots, long, out=np.zeros_like(dots), where=long > 0)
    return cos if metric == "cosine" else (1.0 + cos) / 2.0


def cut_to(parts: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, card, score) arrays as one, with the k best of each query by score, then card."""
    query, card, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((card, -score, query))
    query = query[order]
    order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
    return tuple(np.concatenate(x)[order] for x in zip(*parts))


def best(scores, n: int, cards: np.ndarray, k: int) -> list:
    """Parts for cut_to: the k best cards of queries 0 to n; scores(a, b): a new matrix of the scores of queries a to b.
    Scores that are not finite count for nothing."""
    step, parts = max(1, CELLS // max(1, len(cards))), []
    for a in range(0, n, step):
        s = np.round(scores(a, min(n, a + step)), DECIMALS)
        s[~np.isfinite(s)] = -np.inf
        edge = s.shape[1] - k
        low = np.partition(s, edge, axis=1)[:, edge : edge + 1] if edge > 0 else -np.inf
        rows, cols = np.nonzero((s >= low) & (s > -np.inf))
        parts.append(cut_to([(rows + a, cards[cols], s[rows, cols])], k))
    return parts


def rank(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, then card_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "card_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, index: DataFrame, k: int = CONFIG.top_k, metric: str = "cosine", same: str | None = None, skip_self: bool = True, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, card_id, score, rank of the k best index vectors of each query, exactly.

    queries: query_id, embedding (and `same`); index: card_id, embedding (and `same`). metric: cosine, half_cosine,
    inner or l2 (1 / (1 + squared distance)). With `same`, only vectors with an equal value of that column compete.
    """
    spark, parts = index.sparkSession, []
    keep = [same] if same else []
    for rows in blocks(queries.select("query_id", "embedding", *keep), block):
        ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
        held = spark.sparkContext.broadcast((ids, q, np.array([str(r[2]) for r in rows]) if same else None))

        def run(batches, held=held):
            ids, q, own = held.value
            found = []
            for b in batches:
                if not len(b):
                    continue
                cards, x = b["card_id"].to_numpy(), np.stack(b["embedding"].to_numpy()).astype(np.float64)

                def scores(i, j):
                    s = _scores(q[i:j], x, metric)
                    if skip_self:
                        s[ids[i:j, None] == cards[None, :]] = -np.inf
                    if own is not None:
                        s[own[i:j, None] != b[same].astype(str).to_numpy()[None, :]] = -np.inf
                    return s

                found = [cut_to(found + best(scores, len(ids), cards, k), k)]
            for query, card, score in found:
                yield pd.DataFrame({"query_id": ids[query], "card_id": card, "score": score})

        parts.append(index.select("card_id", "embedding", *keep).mapInPandas(run, RESULT))
    scored = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)
    return rank(scored, k)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session shuffles to, where its files give fewer; large inputs stay as they are."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def hamming_search(queries: DataFrame, index: DataFrame, most: int = CONFIG.max_hamming, top_n: int | None = CONFIG.hamming_top_n, block: int = 2048) -> DataFrame:
    """query_id, card_id, distance, rank of index hashes within `most` bits, by distance then id; queries in blocks."""
    spark, parts = index.sparkSession, []
    for rows in blocks(queries.select("query_id", "hash"), block):
        side = spark.createDataFrame([(r[0], r[1]) for r in rows], "query_id long, query_hash long")
        near = index.select("card_id", "hash").join(F.broadcast(side), hamming(F.col("hash"), F.col("query_hash")) <= most)
        parts.append(near.select("query_id", "card_id", hamming(F.col("hash"), F.col("query_hash")).alias("distance")))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, card_id long, distance long")
    w = Window.partitionBy("query_id").orderBy("distance", "card_id")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top_n) if top_n else ranked


def hamming_join(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """left_id, right_id, distance of all pairs within `most` (at most 7) bits.

    Hashes within r bits agree on one of r + 1 bands; the band index and value are the join key, a pair is reported in
    the first band that it agrees on, and AQE splits the keys that many hashes share.
    """
    if most > 7:
        raise ValueError("bands get too narrow; use hamming_search")
    edges = [64 * i // (most + 1) for i in range(most + 2)]
    band = lambda h, i: F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1 if edges[i + 1] - edges[i] < 64 else -1))
    bands = lambda df, n: df.select(F.col(df.columns[0]).alias(f"{n}_id"), F.col(df.columns[1]).alias(f"{n}_hash"), F.posexplode(F.array(*[band(F.col(df.columns[1]), i) for i in range(most + 1)])).alias("band", "value"))
    pairs = bands(left, "left").join(bands(right, "right"), ["band", "value"])
    first = F.array_position(F.array(*[band(F.col("left_hash"), i) == band(F.col("right_hash"), i) for i in range(most + 1)]), True) - 1
    d = hamming(F.col("left_hash"), F.col("right_hash"))
    return pairs.where((first == F.col("band")) & (d <= most)).select("left_id", "right_id", d.alias("distance"))
