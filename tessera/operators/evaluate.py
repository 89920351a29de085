"""Retrieval metrics, error reports and regression status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CONFIG
from tessera.functions import decide


def joined(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """predictions ⋈ gold on path, with hit1, hit5 and rr.

    predictions: path, match_id, confidence, seconds, candidates (ids in order, maybe empty or null); gold: path,
    gold_id. The list of five starts with the match where it is not among the candidates at all.
    """
    both = predictions.join(gold, "path")
    c = F.coalesce("candidates", F.array().cast("array<string>"))
    m = F.coalesce("match_id", F.lit(""))
    five = F.when((m != "") & ~F.array_contains(c, m), F.concat(F.array(m), F.slice(c, 1, 4))).otherwise(F.slice(c, 1, 5))
    hit1 = m == F.col("gold_id")
    pos = F.array_position(five, F.col("gold_id"))
    some = F.size(c) > 0
    return both.select(
        "*",
        hit1.alias("hit1"),
        F.when(some, pos > 0).otherwise(hit1).alias("hit5"),
        F.when(some, F.when(pos > 0, 1.0 / pos).otherwise(0.0)).otherwise(hit1.cast("double")).alias("rr"),
        F.when(F.array_position(c, F.col("gold_id")) > 0, F.array_position(c, F.col("gold_id"))).otherwise(-1).alias("gold_rank"),
    )


def metrics(predictions: DataFrame, gold: DataFrame, config=CONFIG) -> DataFrame:
    """One row: n, precision_at_1, precision_at_5, mrr, avg_seconds, high_count, high_accuracy, accepted; zeros for no common path."""
    high = F.col("confidence") >= config.high_confidence
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    out = joined(predictions, gold).agg(
        F.count("*").alias("n"),
        share(F.col("hit1")).alias("precision_at_1"),
        share(F.col("hit5")).alias("precision_at_5"),
        share(F.col("rr")).alias("mrr"),
        share(F.col("seconds")).alias("avg_seconds"),
        F.count(F.when(high, 1)).alias("high_count"),
        share(F.when(high, F.col("hit1").cast("double"))).alias("high_accuracy"),
    )
    return out.withColumn("accepted", (F.col("precision_at_1") >= config.goal_p1) & (F.col("precision_at_5") >= config.goal_p5))


def error_report(predictions: DataFrame, gold: DataFrame, top_n: int = 20) -> DataFrame:
    """The wrong matches of highest confidence, with the rank of the right card in the whole list or -1."""
    wrong = joined(predictions, gold).where(~F.col("hit1"))
    return wrong.orderBy(F.desc("confidence"), "path").limit(top_n).select("path", "match_id", "gold_id", "confidence", "gold_rank", "seconds")


def run_metrics(results: DataFrame, config=CONFIG) -> DataFrame:
    """One row: total, processed (without errors), matched and failures by confidence, accept_rate, avg_seconds."""
    ok, sure = F.col("error").isNull(), F.col("confidence") >= config.accept_threshold
    return results.agg(
        F.count("*").alias("total"),
        F.count(F.when(ok, 1)).alias("processed"),
        F.count(F.when(ok & sure, 1)).alias("matched"),
        F.count(F.when(ok & ~sure, 1)).alias("failures"),
        F.coalesce(F.avg(F.when(ok & sure, 1.0).otherwise(0.0)), F.lit(0.0)).alias("accept_rate"),
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"),
    )


def regression(results: DataFrame, expected: DataFrame, config=CONFIG) -> DataFrame:
    """results (file, card_name, confidence) against expected (file, exp_name, exp_confidence) -> status of each file."""
    both = results.join(expected, "file", "left")
    matched = F.when(F.col("card_name").isNotNull(), F.coalesce(F.col("card_name") == F.col("exp_name"), F.lit(False)))
    before = F.when(F.col("exp_name").isNotNull(), F.coalesce("exp_confidence", F.lit(0.0)))
    return both.withColumn("status", decide.regression_status(F.col("confidence"), before, matched, config))


def regression_summary(statuses: DataFrame, config=CONFIG) -> DataFrame:
    """passed, warnings and failed; a REGR counts as a warning on top of its PASS or WARN."""
    s, sure = F.col("status"), F.col("confidence") >= config.regression_pass
    count = lambda c: F.count(F.when(c, 1))
    regr = s == "REGR"
    return statuses.agg(
        count((s == "PASS") | (regr & sure)).alias("passed"),
        (count(s.isin("WARN", "NEW", "REGR")) + count(regr & ~sure)).alias("warnings"),
        count(s.isin("FAIL", "NO MATCH", "ERROR")).alias("failed"),
    )


def nt_xent(vectors: DataFrame, temperature: float = CONFIG.nt_xent_temperature) -> DataFrame:
    """One row: anchors and the mean contrastive loss; vectors: id, batch, view_a, view_b (unit length).

    Within a batch, an anchor's own view_b is its positive and the other anchors' view_b are its negatives; batches have
    a bounded number of rows, as in training.
    """
    from tessera.functions.vectors import dot

    a, b = vectors.select("id", "batch", "view_a"), vectors.select(F.col("id").alias("other"), "batch", "view_b")
    e = a.join(b, "batch").withColumn("e", F.exp(dot(F.col("view_a"), F.col("view_b")) / temperature))
    each = e.groupBy("batch", "id").agg(F.sum(F.when(F.col("id") == F.col("other"), F.col("e"))).alias("pos"), F.sum("e").alias("total"))
    return each.agg(F.count("*").alias("anchors"), F.avg(-F.log(F.col("pos") / F.col("total"))).alias("loss"))
