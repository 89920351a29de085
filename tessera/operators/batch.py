"""Batch results as relations: corrections, display cards, exports, retention.

There is no UPDATE or DELETE: corrections are an append-only log whose latest entry wins, retention rewrites what stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import CONFIG


def latest(log: DataFrame, key: str, at: str, *tie: str) -> DataFrame:
    """The last entry of each key; ties by the columns in tie, greatest first."""
    w = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in tie])
    return log.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def corrected(results: DataFrame, log: DataFrame) -> DataFrame:
    """results with is_corrected, corrected_card_id and correction_reason from the log (image_id, card_id, reason, at)."""
    last = latest(log, "image_id", "at", "card_id").select("image_id", F.col("card_id").alias("corrected_card_id"), F.col("reason").alias("correction_reason"))
    return results.join(last, "image_id", "left").withColumn("is_corrected", F.col("corrected_card_id").isNotNull())


def display_id() -> Column:
    return F.when(F.col("is_corrected"), F.col("corrected_card_id")).otherwise(F.col("matched_card_id"))


def display_cards(results: DataFrame, cards: DataFrame, matched_too: bool) -> DataFrame:
    """results ⋈ the card to display; with matched_too (the results view) the matched card has to exist as well."""
    out = results.withColumn("card_id", display_id())
    if matched_too:
        out = out.join(cards.select(F.col("card_id").alias("matched_card_id")), "matched_card_id", "left_semi")
    return out.join(cards, "card_id")


def result_view(results: DataFrame, cards: DataFrame) -> DataFrame:
    """Display rows with clamped confidence, clarity (null and 0 read as 1) and the number of variants of the card."""
    shown = display_cards(results, cards, True).join(variant_counts(cards), ["name", "set_code"], "left")
    return shown.withColumns({"confidence": F.least(F.lit(1.0), F.col("confidence")), "clarity_score": F.when(F.coalesce("clarity_score", F.lit(0.0)) == 0, 1.0).otherwise(F.col("clarity_score"))})


def export_rows(results: DataFrame, cards: DataFrame) -> DataFrame:
    """The nine columns of the CSV export, as strings; nulls read as empty."""
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return display_cards(results, cards, False).select(
        e("image_filename").alias("filename"), e("name").alias("card_name"), e("set_code").alias("set_code"), e("collector_number").alias("collector_number"), e("finish").alias("finish"), e("source_id").alias("source_id"),
        F.format_string("%.4f", F.col("confidence")).alias("confidence"), F.when(F.col("is_corrected"), "Yes").otherwise("No").alias("corrected"), e("correction_reason").alias("correction_reason"),
    )


def variant_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy("name", "set_code").agg(F.count("*").alias("variants"))


def alternate_finish(cards: DataFrame, finish: Column | None = None) -> DataFrame:
    """card_id, other_id: cards of the same name, set and number in another finish (in `finish`, if given)."""
    key = ["name", "set_code", "collector_number"]
    other = cards.select(F.col("card_id").alias("other_id"), F.col("finish").alias("other_finish"), *key)
    out = cards.select("card_id", "finish", *key).join(other, key).where("finish <> other_finish")
    out = out.where(F.col("other_finish") == finish) if finish is not None else out
    return out.select("card_id", "finish", "other_id", "other_finish")


def toggle_finish(results: DataFrame, cards: DataFrame, finish: str) -> DataFrame:
    """Log entries (image_id, card_id, reason) for results whose card exists in `finish` too; equal finishes need none."""
    if finish not in ("foil", "nonfoil"):
        raise ValueError("finish must be foil or nonfoil")
    other = alternate_finish(cards, F.lit(finish)).groupBy("card_id").agg(F.min("other_id").alias("other_id"))
    return results.withColumn("card_id", display_id()).join(other, "card_id").select("image_id", F.col("other_id").alias("card_id"), F.lit("finish_toggle").alias("reason"))


def search(cards: DataFrame, query: str, set_code: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of cards whose name contains query in any case; % and _ in it are wildcards; in card_id order."""
    out = cards.where(F.col("name").ilike(f"%{query}%"))
    out = out.where(F.col("set_code") == set_code.upper()) if set_code else out
    return out.orderBy("card_id").offset(offset).limit(limit)


def select_cards(cards: DataFrame, set_code: str | None = None, finish: str | None = None, card_id=None, collector_number: str | None = None, image_path: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows that meet the predicates given; a limit takes the first by card_id."""
    wanted = {"set_code": set_code and set_code.upper(), "finish": finish and finish.lower(), "card_id": card_id, "collector_number": collector_number, "image_path": image_path}
    for c, v in wanted.items():
        cards = cards.where(F.col(c) == v) if v is not None else cards
    return cards.orderBy("card_id").limit(limit) if limit else cards


def set_codes(cards: DataFrame) -> DataFrame:
    return cards.where("set_code <> ''").select(F.upper("set_code").alias("set_code")).distinct().orderBy("set_code")


def expired(batches: DataFrame, now: Column, config=CONFIG) -> DataFrame:
    """Batches created before now minus the retention, strictly."""
    return batches.where(F.col("created_at") < now - F.make_dt_interval(hours=F.lit(config.retention_hours)))


def retained(batches: DataFrame, results: DataFrame, now: Column, config=CONFIG) -> tuple[DataFrame, DataFrame]:
    """What is left of batches and, in cascade, of results."""
    old = expired(batches, now, config).select("batch_id")
    return batches.join(old, "batch_id", "left_anti"), results.join(old, "batch_id", "left_anti")


def retention_stats(batches: DataFrame, results: DataFrame, now: Column, config=CONFIG) -> DataFrame:
    """One row: batches and results to delete, and their bytes in MB with two decimals."""
    old = expired(batches, now, config).select("batch_id", "status")
    gone = results.join(old.select("batch_id"), "batch_id", "left_semi")
    per = gone.groupBy("batch_id").agg(F.count("*").alias("results"), F.sum("bytes").alias("bytes"))
    both = old.join(per, "batch_id", "left")
    return both.agg(F.count("*").alias("batches_deleted"), F.coalesce(F.sum("results"), F.lit(0)).alias("results_deleted"), F.round(F.coalesce(F.sum("bytes"), F.lit(0.0)) / (1024 * 1024), 2).alias("mb_freed"))


def orphans(folders: DataFrame, batches: DataFrame) -> DataFrame:
    return folders.join(batches.select("batch_id"), "batch_id", "left_anti")


def progress(batches: DataFrame, results: DataFrame) -> DataFrame:
    """batch_id, total, processed, share and seconds a card; a batch without cards has a share of 0."""
    done = results.groupBy("batch_id").agg(F.count("*").alias("processed"))
    out = batches.join(done, "batch_id", "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("created_at")
    return out.select("batch_id", "status", "total", "processed", F.coalesce(F.try_divide(F.col("processed"), F.col("total")), F.lit(0.0)).alias("share"), F.try_divide(seconds, F.col("processed")).alias("seconds_per_card"))
