"""Queries over the vector index, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.functions.hashing import hash_to_hex, hex_to_hash
from tessera.functions.vectors import composite, norm
from tessera.operators import ann, evaluate, rerank, retrieve

from . import standins as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SCORE = {
    "cosine": "list_inner_product(q.v, c.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(c.v, c.v))",
    "inner": "list_inner_product(q.v, c.v)",
    "half_cosine": "(1 + list_inner_product(q.v, c.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(c.v, c.v))) / 2",
    "l2": "1 / (1 + list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, c.v) + list_inner_product(c.v, c.v))",
}


def _top(metric: str, extra: str = "") -> str:
    return f"""WITH {S.VECTORS_SQL}, s AS (SELECT q.card_id AS query_id, c.card_id, q.label AS q_label, c.label, q.h AS qh, c.h AS ch, {SCORE[metric]} AS score FROM e q, e c WHERE q.card_id % {S.EVERY} = 0 AND q.card_id <> c.card_id {extra}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, card_id) AS rank FROM s) WHERE rank <= {CONFIG.top_k})"""


PICK = " SELECT query_id, card_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM top"


def _picked(df):
    return df.select("query_id", "card_id", "rank", F.round("score", 6).alias("score"))


def _search(spark, d, metric="cosine", same=None):
    v = S.vectors(spark, d)
    return retrieve.top_k(S.queries(v), v, metric=metric, same=same)


@query(_top("cosine") + PICK)
def vec_topk_cosine(spark, d):
    return _picked(_search(spark, d))


@query(_top("inner") + PICK)
def vec_topk_inner(spark, d):
    return _picked(_search(spark, d, "inner"))


@query(_top("l2") + PICK)
def vec_topk_l2_score(spark, d):
    return _picked(_search(spark, d, "l2"))


@query(_top("half_cosine") + PICK)
def vec_topk_halfcos(spark, d):
    return _picked(_search(spark, d, "half_cosine"))


@query(_top("cosine", "AND q.label = c.label") + PICK)
def vec_topk_by_label(spark, d):
    return _picked(_search(spark, d, same="label"))


@query(_top("cosine") + PICK)
def vec_unified_topk(spark, d):
    """The best over the partitions of the index: each partition's own best, ranked together."""
    v = S.vectors(spark, d)
    even, odd = v.where("label % 2 = 0"), v.where("label % 2 = 1")
    q = S.queries(v)
    both = retrieve.top_k(q, even).drop("rank").unionByName(retrieve.top_k(q, odd).drop("rank"))
    return _picked(retrieve.rank(both, CONFIG.top_k))


@query(
    f"""WITH {S.VECTORS_SQL}, n AS (SELECT count(*) AS n FROM e),
p AS (SELECT a.card_id, a.card_id % 5 = 0 AS lone, a.v AS f, CASE WHEN a.card_id % 5 = 0 THEN a.v ELSE b.v END AS c, x.v AS m FROM e a JOIN n ON true JOIN e b ON b.card_id = (a.card_id * 7 + 1) % n.n JOIN e x ON x.card_id = (a.card_id * 3 + 2) % n.n),
l AS (SELECT *, sqrt(list_inner_product(f, f)) AS nf, sqrt(list_inner_product(c, c)) AS nc, sqrt(list_inner_product(m, m)) AS nm FROM p),
u AS (SELECT card_id, lone, list_transform(f, lambda t: t / nf) AS f, list_transform(c, lambda t: t / nc) AS c, list_transform(m, lambda t: t / nm) AS m FROM l),
w AS (SELECT card_id, CASE WHEN lone THEN f ELSE list_transform(range(1, 65), lambda i: 0.7 * f[i] + 0.2 * c[i] + 0.1 * m[i]) END AS x FROM u)
SELECT card_id, round(sqrt(list_inner_product(x, x)), 6) AS norm, round(x[1] / sqrt(list_inner_product(x, x)), 6) AS d1, round(x[2] / sqrt(list_inner_product(x, x)), 6) AS d2, round(x[64] / sqrt(list_inner_product(x, x)), 6) AS d64 FROM w""".replace("round(sqrt(list_inner_product(x, x)), 6) AS norm", "1.0::DOUBLE AS norm")
)
def composite_embedding(spark, d):
    v = S.vectors(spark, d).select("card_id", "embedding")
    n = v.count()
    b = v.select(F.col("card_id").alias("b_id"), F.col("embedding").alias("collector"))
    x = v.select(F.col("card_id").alias("x_id"), F.col("embedding").alias("name"))
    three = v.join(b, F.col("b_id") == (F.col("card_id") * 7 + 1) % n).join(x, F.col("x_id") == (F.col("card_id") * 3 + 2) % n)
    e = three.select("card_id", composite(F.col("embedding"), F.when(F.col("card_id") % 5 != 0, F.col("collector")), F.col("name")).alias("e"))
    return e.select("card_id", F.round(norm(F.col("e")), 6).alias("norm"), *[F.round(F.get("e", F.lit(i - 1)), 6).alias(f"d{i}") for i in (1, 2, 64)])


@query(f"WITH {S.VECTORS_SQL} SELECT card_id, lpad(lower(to_hex(h)), 16, '0') AS hash_hex, CAST(bit_count(h) AS BIGINT) AS ones, true AS round_trip FROM e")
def hash_bits_hex(spark, d):
    v = S.vectors(spark, d).select("card_id", "hash", hash_to_hex(F.col("hash")).alias("hash_hex"))
    return v.select("card_id", "hash_hex", F.bit_count("hash").cast("bigint").alias("ones"), (hex_to_hash(F.col("hash_hex")) == F.col("hash")).alias("round_trip"))


_NEAR = f"WITH {S.VECTORS_SQL}, s AS (SELECT q.card_id AS query_id, c.card_id, CAST(bit_count(xor(q.h, c.h)) AS BIGINT) AS distance FROM e q, e c WHERE q.card_id % {S.EVERY} = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, card_id) AS rank FROM s WHERE distance <= {{0}}) SELECT query_id, card_id, distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {{1}}"


@query(_NEAR.format(26, 20))
def hamming_topn(spark, d):
    v = S.vectors(spark, d)
    return retrieve.hamming_search(S.queries(v), v, 26, 20)


@query(_NEAR.format(CONFIG.max_hamming, CONFIG.hamming_top_n))
def hamming_range(spark, d):
    v = S.vectors(spark, d)
    return retrieve.hamming_search(S.queries(v), v)


@query(f"WITH {S.VECTORS_SQL} SELECT q.card_id AS left_id, c.card_id AS right_id, CAST(bit_count(xor(q.h & 16777215, c.h & 16777215)) AS BIGINT) AS distance FROM e q, e c WHERE bit_count(xor(q.h & 16777215, c.h & 16777215)) <= 3")
def hamming_banded_join(spark, d):
    """All pairs within 3 bits on the low 24 bits of the hashes."""
    h = S.vectors(spark, d).select("card_id", F.col("hash").bitwiseAND(F.lit((1 << 24) - 1)).alias("hash"))
    return retrieve.hamming_join(h, h, 3)


_FUSED = (
    _top("cosine")
    + f""", f0 AS (SELECT *, 0.6 * (1 - least(bit_count(xor(qh, ch)) / 64.0::DOUBLE, 1)) + 0.3 * (1 - least(bit_count(xor(qh, ch) & {(1 << 48) - 1}::HUGEINT) / 64.0::DOUBLE, 1)) + 0.1 * (1 - least(bit_count(xor(qh, ch) & 65535::HUGEINT) / 64.0::DOUBLE, 1)) AS hash_score FROM top),
f1 AS (SELECT query_id, card_id, rank AS r0, score AS embedding_score, hash_score, 0.85::DOUBLE * score + 0.15::DOUBLE * hash_score AS score, label FROM f0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS rank FROM f1)"""
)


def _fused(spark, d):
    v = S.vectors(spark, d)
    return rerank.fuse_hashes(retrieve.top_k(S.queries(v), v), S.hashes(v))


@query(_FUSED + " SELECT query_id, card_id, CAST(rank AS INTEGER) AS rank, round(embedding_score, 6) AS embedding_score, round(hash_score, 6) AS hash_score, round(score, 6) AS score FROM f")
def hash_fused_score(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    return _fused(spark, d).select("query_id", "card_id", "rank", r("embedding_score"), r("hash_score"), r("score"))


def _decide_sql(source: str, injected: str = "false") -> str:
    return f""", t AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2, max(CASE WHEN rank = 3 THEN score END) AS s3, max(CASE WHEN rank = 1 THEN card_id END) AS match_card_id, bool_or(rank = 1 AND {injected}) AS inj FROM {source} GROUP BY query_id),
u AS (SELECT *, CASE WHEN s2 IS NULL THEN false WHEN s3 IS NOT NULL THEN s1 - s3 < 0.1 ELSE s1 - s2 < 0.1 END AS is_ambiguous FROM t)
SELECT query_id, match_card_id, round(s1, 6) AS confidence, round(CASE WHEN s2 IS NULL THEN 1 ELSE s1 - s2 END, 6) AS clarity, is_ambiguous, CASE WHEN inj THEN 'ocr_triangulation' WHEN s1 >= 0.85 AND is_ambiguous THEN 'ambiguous_high' WHEN s1 >= 0.85 THEN 'auto_accept' ELSE 'manual_review' END AS decision FROM u"""


def _decided(rows):
    return rerank.decisions(rows).select("query_id", "match_card_id", F.round("confidence", 6).alias("confidence"), F.round("clarity", 6).alias("clarity"), "is_ambiguous", "decision")


@query(_FUSED + _decide_sql("f"))
def match_decide(spark, d):
    return _decided(_fused(spark, d))


_SIM = "((query_id * 31 + card_id * 17) % 100) / 100.0"
_BAND = f"CASE WHEN rank > 5 THEN score WHEN sim > 0.5 THEN least(1.0, score * (1 + 0.5 * sim)) WHEN sim > 0.3 THEN least(1.0, score * (1 + 0.3 * sim)) ELSE score * 0.95 END"


@query(
    _FUSED
    + f""", k0 AS (SELECT query_id, card_id, rank, score, CAST({_SIM} AS DOUBLE) AS sim FROM f), k1 AS (SELECT query_id, card_id, rank AS r1, {_BAND} AS score FROM k0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1) AS rank FROM k1) SELECT query_id, card_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM k"""
)
def rerank_bands(spark, d):
    similarity = F.pmod(F.col("query_id") * 31 + F.col("card_id") * 17, F.lit(100)) / 100.0
    return _picked(rerank.keypoints(_fused(spark, d), similarity))


_GATE = (
    _FUSED
    + """, g0 AS (SELECT *, max(CASE WHEN rank = 1 THEN score END) OVER w AS s1, max(CASE WHEN rank = 2 THEN score END) OVER w AS s2, max(CASE WHEN rank = 3 THEN score END) OVER w AS s3 FROM f WINDOW w AS (PARTITION BY query_id)),
g1 AS (SELECT query_id, card_id, rank AS r1, CASE WHEN (s1 - s3 < 0.1 OR s1 < 0.85) AND card_id % 7 = 0 THEN least(1.0, score + 0.15) ELSE score END AS score FROM g0),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1, card_id) AS rank FROM g1)"""
)


@query(_GATE + " SELECT query_id, card_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM g")
def ocr_gate_boost(spark, d):
    return _picked(rerank.boost_matched(rerank.gated(_fused(spark, d)), F.col("card_id") % 7 == 0))


_INJECT = """, found AS (SELECT card_id AS query_id, CASE WHEN card_id % 20 = 0 THEN (card_id * 3 + 1) % (SELECT count(*) FROM e) END AS found_id FROM e WHERE card_id % 10 = 0),
i0 AS (SELECT f.query_id, card_id, rank AS r1, CASE WHEN card_id = found_id THEN least(1.0, score + 0.3) ELSE score END AS score, false AS injected FROM f JOIN found USING (query_id)
 UNION ALL SELECT query_id, found_id, 0, 0.95, true FROM found WHERE found_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = found.query_id AND f.card_id = found_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1, card_id) AS rank FROM i0)"""


@query(_FUSED + _INJECT + _decide_sql("i", "injected"))
def triangulation_inject(spark, d):
    v = S.vectors(spark, d)
    n = v.count()
    found = S.queries(v).where("query_id % 20 = 0").select("query_id", ((F.col("query_id") * 3 + 1) % n).alias("card_id"))
    return _decided(rerank.inject(_fused(spark, d), found))


_SETS = _top("cosine").replace("PARTITION BY query_id", "PARTITION BY query_id, label") + ", b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label, card_id) AS n FROM top WHERE rank = 1) SELECT query_id, card_id, label, round(score, 6) AS score FROM b WHERE n = 1"


@query(_SETS)
def best_over_sets(spark, d):
    """Every set searched alone, then the best first candidate."""
    v = S.vectors(spark, d)
    rows = retrieve.top_k(S.queries(v), v).where("rank = 1").join(v.select("card_id", "label"), "card_id")
    return rerank.best_over(rows, "label").select("query_id", "card_id", "label", F.round("score", 6).alias("score"))


@query(
    _top("cosine").replace("PARTITION BY query_id", "PARTITION BY query_id, label % 2")
    + """, a AS (SELECT * FROM top WHERE rank = 1 AND label % 2 = 0 AND query_id % 30 <> 0), b AS (SELECT * FROM top WHERE rank = 1 AND label % 2 = 1 AND query_id % 20 <> 0),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.card_id AS fc, a.score AS fs, b.card_id AS pc, b.score AS ps FROM a FULL JOIN b ON a.query_id = b.query_id)
SELECT query_id, CASE WHEN fs >= 0.85 OR ps IS NULL THEN fc ELSE pc END AS card_id, round(CASE WHEN fs >= 0.85 OR ps IS NULL THEN fs ELSE ps END, 6) AS score, CASE WHEN fs >= 0.85 OR ps IS NULL THEN 'foil' ELSE 'nonfoil' END AS finish FROM j"""
)
def prefer_finish_policy(spark, d):
    v = S.vectors(spark, d)
    q = S.queries(v)
    foil = retrieve.top_k(q.where("query_id % 30 <> 0"), v.where("label % 2 = 0"), 1)
    plain = retrieve.top_k(q.where("query_id % 20 <> 0"), v.where("label % 2 = 1"), 1)
    return rerank.prefer_finish(foil, plain).select("query_id", "card_id", F.round("score", 6).alias("score"), "finish")


def _predictions(spark, d):
    """Label as the answer: the first candidate's label predicts, the labels of the candidates in order are the list."""
    v = S.vectors(spark, d)
    top = retrieve.top_k(S.queries(v), v).join(v.select("card_id", "label"), "card_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("label").cast("string").alias("l")))), lambda x: x["l"])
    p = top.groupBy("query_id").agg(ordered.alias("all"), F.max("score").alias("confidence"))
    seconds = (F.col("query_id") % 7) / 10.0
    p = p.select(F.col("query_id").cast("string").alias("path"), F.get("all", F.lit(0)).alias("match_id"), "confidence", seconds.alias("seconds"), F.when(F.col("query_id") % 50 == 0, F.array().cast("array<string>")).when(F.col("query_id") % 30 == 0, F.slice("all", 2, 9)).otherwise(F.col("all")).alias("candidates"))
    gold = v.select(F.col("card_id").cast("string").alias("path"), F.col("label").cast("string").alias("gold_id"))
    return p, gold


_EVAL = (
    _top("cosine")
    + """, p0 AS (SELECT query_id, list(CAST(label AS VARCHAR) ORDER BY rank) AS l, max(score) AS confidence FROM top GROUP BY query_id),
p AS (SELECT query_id, CAST(query_id AS VARCHAR) AS path, l[1] AS match_id, confidence, (query_id % 7) / 10.0::DOUBLE AS seconds, CASE WHEN query_id % 50 = 0 THEN []::VARCHAR[] WHEN query_id % 30 = 0 THEN l[2:10] ELSE l END AS c FROM p0),
x AS (SELECT p.*, CAST(e.label AS VARCHAR) AS gold_id, CASE WHEN list_contains(c, match_id) THEN c[1:5] ELSE list_prepend(match_id, c[1:4]) END AS five FROM p JOIN e ON e.card_id = p.query_id),
y AS (SELECT *, match_id = gold_id AS hit1, CASE WHEN len(c) = 0 THEN match_id = gold_id ELSE list_contains(five, gold_id) END AS hit5, CASE WHEN len(c) = 0 THEN (match_id = gold_id)::INTEGER::DOUBLE WHEN list_contains(five, gold_id) THEN 1.0::DOUBLE / list_position(five, gold_id) ELSE 0 END AS rr, CASE WHEN list_contains(c, gold_id) THEN list_position(c, gold_id) ELSE -1 END AS gold_rank FROM x)"""
)


@query(
    _EVAL
    + """ SELECT count(*) AS n, round(avg(hit1::INTEGER), 6) AS precision_at_1, round(avg(hit5::INTEGER), 6) AS precision_at_5, round(avg(rr), 6) AS mrr, round(avg(seconds), 6) AS avg_seconds, count(*) FILTER (confidence >= 0.85) AS high_count, round(coalesce(avg(hit1::INTEGER) FILTER (confidence >= 0.85), 0), 6) AS high_accuracy, avg(hit1::INTEGER) >= 0.95 AND avg(hit5::INTEGER) >= 0.99 AS accepted FROM y"""
)
def eval_metrics(spark, d):
    m = evaluate.metrics(*_predictions(spark, d))
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("precision_at_1", "precision_at_5", "mrr", "avg_seconds")], "high_count", F.round("high_accuracy", 6).alias("high_accuracy"), "accepted")


@query(_EVAL + " SELECT path, match_id, gold_id, round(confidence, 6) AS confidence, CAST(gold_rank AS BIGINT) AS gold_rank, seconds FROM (SELECT * FROM y WHERE NOT hit1 ORDER BY confidence DESC, path LIMIT 20)")
def eval_error_report(spark, d):
    return evaluate.error_report(*_predictions(spark, d)).select("path", "match_id", "gold_id", F.round("confidence", 6).alias("confidence"), F.col("gold_rank").cast("bigint").alias("gold_rank"), "seconds")


@query(
    f"""WITH {S.VECTORS_SQL}, n AS (SELECT count(*) AS n FROM e), s AS (SELECT a.card_id, a.card_id = b.card_id AS own, exp(list_inner_product(a.v, x.v) / 0.07) AS ex FROM e a JOIN n ON true JOIN e b ON a.card_id // 32 = b.card_id // 32 JOIN e x ON x.card_id = (b.card_id + 1) % n.n),
g AS (SELECT card_id, sum(CASE WHEN own THEN ex END) AS pos, sum(ex) AS total FROM s GROUP BY card_id) SELECT count(*) AS anchors, round(avg(-ln(pos / total)), 6) AS loss FROM g"""
)
def ntxent_loss(spark, d):
    v = S.vectors(spark, d).select("card_id", "embedding")
    n = v.count()
    nxt = v.select(F.pmod(F.col("card_id") - 1, F.lit(n)).alias("card_id"), F.col("embedding").alias("view_b"))
    rows = v.join(nxt, "card_id").select(F.col("card_id").alias("id"), F.floor(F.col("card_id") / 32).alias("batch"), F.col("embedding").alias("view_a"), "view_b")
    return evaluate.nt_xent(rows).select("anchors", F.round("loss", 6).alias("loss"))


#: The share of exact results that the clustered index has to find.
RECALL = 0.9


@query()
def vec_topk_ivf(spark, d):
    """query_id, card_id, score, rank by an index of 16 lists, as many probed as a recall of RECALL takes; recall against exact search."""
    v = S.vectors(spark, d).select("card_id", "embedding")
    centres = ann.fit_lists(v, 16)
    q = S.queries(v)
    listed = ann.assign_lists(v, centres)
    found = ann.probe(q, listed, centres, CONFIG.top_k, ann.probes_for(q, listed, centres, CONFIG.top_k, RECALL))
    r = ann.recall(found, retrieve.top_k(q, v))
    return found.select("query_id", "card_id", F.round("score", 6).alias("score"), "rank").crossJoin(r.select(F.round("recall", 4).alias("recall")))


