"""The corpus pipeline: five operators of tessera.llm, each stage reading what the one before wrote."""

from __future__ import annotations

import uuid

from tessera.llm import stages
from tessera.llm.common import shared_dir

STAGES = [
    ("quality rules", stages.quality),
    ("exact dedup", stages.exact),
    ("simhash near-dedup", stages.near),
    ("mixing to target weights", stages.mixed),
    ("byte-level bpe", stages.tokens),
]

#: Robust estimates, fitted rates and tokenising are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES over documents; what a stage returns is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
