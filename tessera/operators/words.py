"""Aggregation of words that a text reader returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_words(words: DataFrame) -> DataFrame:
    """key, text, confidence: the non-blank words in order, and the mean of confidence / 100 where it is not negative."""
    full = F.trim("word") != ""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(full, F.struct("ord", F.trim("word").alias("w"))))), lambda x: x["w"]), " ")
    mean = F.avg(F.when(full & (F.col("conf") >= 0), F.col("conf") / 100.0))
    return words.groupBy("key").agg(text.alias("text"), F.coalesce(mean, F.lit(0.0)).alias("confidence"))
