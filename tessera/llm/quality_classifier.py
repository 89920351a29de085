"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Class means and covariances come from one distributed aggregation over all labelled training rows. Each covariance is
shrunk towards its diagonal and towards the pooled covariance; its Cholesky factor is inverted once, kept in the model,
and sent to the tasks (K classes x d^2 numbers, whatever the size of the corpus). A score is the posterior of label 1:
the logistic of the difference of Gaussian log-densities plus the log prior odds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, texts
from .text_stats import NAMES, matrix

SHRINK_DIAGONAL = 0.1
SHRINK_POOLED = 0.05
#: Least standard deviation of a statistic.
FLOOR = 0.05
#: The difference of log-densities is divided by this, as the statistics are not quite Gaussian.
TEMPERATURE = 2.0
THRESHOLD = 0.3
D = len(NAMES)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics f0.. of each row; null text as empty."""

    def run(batches):
        for b in batches:
            x = matrix(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], **{f"f{i}": x[:, i] for i in range(D)}})

    return texts(docs).mapInPandas(run, "doc_id long, " + ", ".join(f"f{i} double" for i in range(D)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Discriminant:
    """log prior, mean and inverse Cholesky factor of each class; predict_proba of class 1."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        total = sum(n for n, _, _ in moments.values())
        cov = {k: (q - np.outer(m, m)) for k, (_, m, q) in moments.items()}
        pooled = sum(moments[k][0] / total * cov[k] for k in moments) if total else np.eye(D)
        self.classes = {}
        for k, (n, m, _) in moments.items():
            c = (1 - SHRINK_POOLED) * cov[k] + SHRINK_POOLED * pooled
            c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c)) + FLOOR**2 * np.eye(D)
            factor = np.linalg.cholesky(c)
            self.classes[k] = (np.log((n + 1) / (total + 2)), m, np.linalg.inv(factor), np.log(np.diag(factor)).sum())

    def log_density(self, k: int, x: np.ndarray) -> np.ndarray:
        _, m, inverse, half_det = self.classes[k]
        z = (x - m) @ inverse.T
        return -0.5 * (z * z).sum(1) - half_det

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:  # one class or no labels: the prior
            return np.full(len(x), 0.5 if not self.classes else 1.0 * next(iter(self.classes)))
        odds = (self.log_density(1, x) - self.log_density(0, x)) / TEMPERATURE + self.classes[1][0] - self.classes[0][0]
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """rows: features; labels: doc_id, quality. Held-out rows, null and other labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    pairs = [(i, j) for i in range(D) for j in range(i + 1)]
    got = rows.join(known, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), *[F.avg(f"f{i}").alias(f"m{i}") for i in range(D)], *[F.avg(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}_{j}") for i, j in pairs]).collect()
    moments = {}
    for r in got:
        q = np.zeros((D, D))
        for i, j in pairs:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        moments[r["quality"]] = (r["n"], np.array([r[f"m{i}"] for i in range(D)]), q)
    return Discriminant(moments)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. An empty table gives no rows, no labels scores of 0.5."""
    rows = cut(features(docs))
    model = rows.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.value.score(b[[f"f{i}" for i in range(D)]].to_numpy())})

    scored = rows.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
