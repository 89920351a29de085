"""The operators as stages of a pipeline: each takes (spark, docs, sf_dir) and keeps the columns of docs.

Whoever writes a stage's rows holds a row group of them in each task, and the next stage reads whole ones; so the stages
that return texts have the session write small groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, mixing, quality_rules, simhash
from .common import BROADCAST_IDS, ROW, bounded_groups, cut, documents, kept_rows, with_row

#: Shares of tokens that the pipeline aims at, the tokens to have, and the least and greatest rate of a document.
PIPELINE_TARGETS = {"good": 0.86, "poor": 0.02, "toxic": 0.12}
PIPELINE_GROWTH = 1.15
PIPELINE_FLOOR, PIPELINE_CAP = 1.0, 4.0


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    bounded_groups(spark)
    docs = with_row(docs)
    return kept_rows(docs, quality_rules.quality_rules(docs, key=ROW).select(*ROW, "kept"), False)


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    bounded_groups(spark)
    docs = with_row(docs)
    return kept_rows(docs, exact_dedup.exact_dedup(docs, key=ROW).select(*ROW, "kept"), True)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the smallest id, and one row of it."""
    bounded_groups(spark)
    docs = with_row(docs)
    return kept_rows(docs, simhash.simhash_components(docs, ROW).select(*ROW, "kept"), True)


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, and again for rows whose rate calls for more copies; none is dropped, as the least rate is 1.

    The classifier is fitted on the labelled rows of the whole documents table, not only on those that earlier stages left.
    """
    bounded_groups(spark)
    known = mixing.labelled(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = with_row(docs)
    rates = mixing.mix(rows, known, PIPELINE_TARGETS, PIPELINE_GROWTH, PIPELINE_FLOOR, PIPELINE_CAP, key=ROW, fit_on=documents(spark, sf_dir))
    more = cut(rates.where("copies > 1").groupBy(*ROW).agg(F.first("copies").alias("__copies")))
    side = F.broadcast(more) if more.count() <= BROADCAST_IDS else more
    times = F.explode(F.sequence(F.lit(1), F.coalesce("__copies", F.lit(1))))
    return rows.join(side, list(ROW), "left").select(*[rows[c] for c in docs.columns], times.alias("__copy")).drop("__copy")


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids' and the decoded text's digests of each row that is left."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
