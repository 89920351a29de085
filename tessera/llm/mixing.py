"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table predicts every document's posterior over the domains. A document then counts
for each domain with that share of its tokens. Document rates r >= floor are fitted so that the expected token totals
A r, with A = posterior * tokens, match the targets t in least squares, by accelerated projected gradient from r = 1.

The residuals are weighted by the inverse of G, the token-weighted second moments of the posteriors, and r is rescaled
by the square root of tokens. Then the gradient has Lipschitz constant 1 and, while no bound is active, condition number
1, and one document's step is a small function of the K residuals alone: r_i <- clip(y_i - p_i . G^-1 (A y - t) / T).
So the state of the whole fit is the history of K numbers, which goes to the tasks (at most `steps` x K numbers); each iteration folds the history over a written table
of posteriors and returns K partial sums a batch. Nothing else is shuffled, and no document is collected.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, texts
from .text_stats import NAMES, matrix

#: Labelled rows, by hash order, that the classifier is fitted on: a bound of the driver's memory.
FIT_ROWS = 4_000
FIT_WORDS = 200
STEPS = 60
#: Of all tokens: the gap to the targets that ends the fit, and the progress below which it stands still.
TOLERANCE = 1e-4
STALL = 1e-7
CAP = 8.0
DOMAINS = ("good", "poor", "toxic")
TARGETS = {"good": 0.8, "poor": 0.15, "toxic": 0.05}
_WORD = re.compile(r"[^\W\d_]+")


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, domain from the labels table: toxic, else good or poor by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).where("domain IS NOT NULL")


def present(text: str) -> set[str]:
    """The words of a text that the classifier knows of."""
    return set(_WORD.findall(text.lower()))


class Classifier:
    """Softmax regression over document statistics and the presence of some words."""

    def __init__(self, names: tuple[str, ...], words: list[str], x: np.ndarray, domains: list[str], ridge: float = 1e-3, rounds: int = 400):
        """x: statistics and presence of words, a row a document; domains: their labels."""
        self.names, self.words = names, {w: i for i, w in enumerate(words)}
        y = np.array([names.index(d) for d in domains], int)
        self.mean, self.scale = (x.mean(0), x.std(0) + 0.1) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        x = np.hstack(((x - self.mean) / self.scale, np.ones((len(x), 1))))
        self.w = np.zeros((x.shape[1], len(names)))
        goal, step = np.eye(len(names))[y], 1.0 if not len(x) else 1.0 / (0.5 * np.linalg.eigvalsh(x.T @ x / len(x))[-1] + ridge)
        ahead = self.w
        for i in range(rounds if len(x) else 0):
            p = self._softmax(x @ ahead)
            new = ahead - step * (x.T @ (p - goal) / len(x) + ridge * ahead)
            ahead, self.w = new + i / (i + 3) * (new - self.w), new

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _raw(self, some: list[str]) -> np.ndarray:
        hits = np.zeros((len(some), len(self.words)))
        known = self.words.keys()
        for i, t in enumerate(some):
            hits[i, [self.words[w] for w in known & present(t)]] = 1
        return np.hstack((matrix(some).reshape(len(some), len(NAMES)), hits))

    def posterior(self, some: list[str]) -> np.ndarray:
        x = (self._raw(some) - self.mean) / self.scale
        return self._softmax(np.hstack((x, np.ones((len(x), 1)))) @ self.w)


def fit_classifier(docs: DataFrame, domains: DataFrame, names: tuple[str, ...]) -> Classifier:
    """Fit on FIT_ROWS labelled rows, the first by a hash of the id, over their whole texts.

    Statistics and words are taken where the texts lie, and the words that tell the domains apart best are found by a
    distributed count; the driver gets a narrow row for each of the FIT_ROWS.
    """
    pick = domains.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(FIT_ROWS)

    def run(batches):
        for b in batches:
            some = b["text"].tolist()
            yield pd.DataFrame({"doc_id": b["doc_id"], "domain": b["domain"], "x": list(matrix(some)), "words": [sorted(present(t)) for t in some]})

    rows = docs.join(F.broadcast(pick), "doc_id").select("doc_id", "text", "domain")
    rows = rows.mapInPandas(run, "doc_id long, domain string, x array<double>, words array<string>")
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    first = rows.select("at", "doc_id", "domain", F.xxhash64("x").alias("digest")).orderBy(F.xxhash64("doc_id"), "doc_id", "domain", "digest", "at").limit(FIT_ROWS)
    rows = cut(rows.join(F.broadcast(first.select("at")), "at", "left_semi"))
    n = {r[0]: r[1] + 1.0 for r in rows.groupBy("domain").count().collect()}
    rate = [(F.count(F.when(F.col("domain") == k, 1)) + 0.5) / n.get(k, 1.0) for k in names]
    seen = rows.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.array(*rate).alias("rate"))
    gain = F.sqrt(F.array_max("rate")) - F.sqrt(F.array_min("rate"))
    words = [r[0] for r in seen.where("n >= 5").orderBy(F.desc(gain), "word").limit(FIT_WORDS).select("word").collect()]
    hits = F.array_intersect("words", F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    got = rows.select("doc_id", "domain", "x", hits.alias("hits")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["domain"], r["x"]))
    place, x = {w: i for i, w in enumerate(words)}, np.zeros((len(got), len(NAMES) + len(words)))
    for i, r in enumerate(got):
        x[i, : len(NAMES)] = r["x"]
        x[i, [len(NAMES) + place[w] for w in r["hits"]]] = 1
    return Classifier(names, words, x, [r["domain"] for r in got])


def memberships(docs: DataFrame, model: Classifier, key: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, key (long columns), n_tokens and the posteriors p0.. of each row; tokens are the words between white space."""
    held, k = docs.sparkSession.sparkContext.broadcast(model), len(model.names)

    def run(batches):
        for b in batches:
            some = b["text"].tolist()
            p = held.value.posterior(some)
            yield pd.DataFrame({"doc_id": b["doc_id"], **{c: b[c] for c in key}, "n_tokens": [len(t.split()) for t in some], **{f"p{i}": p[:, i] for i in range(k)}})

    return docs.mapInPandas(run, ", ".join([f"{c} long" for c in ("doc_id", *key, "n_tokens")] + [f"p{i} double" for i in range(k)]))


class Fit:
    """The residual history of an accelerated projected gradient; rates(p) replays it for any documents."""

    def __init__(self, floor: float, cap: float):
        self.floor, self.cap, self.history = floor, cap, []

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates and the extrapolated point after all steps so far, for rows of posteriors."""
        r = np.clip(np.ones(len(p)), self.floor, self.cap)
        y = r
        for k, g in enumerate(self.history):
            new = np.clip(y - p @ g, self.floor, self.cap)
            r, y = new, new + k / (k + 3) * (new - r)
        return r, y


def fit_rates(rows: DataFrame, targets: np.ndarray, floor: float, cap: float, steps: int = STEPS) -> tuple[Fit, np.ndarray]:
    """The fit for a written table of memberships, and the domain totals that it reaches."""
    k, context = len(targets), rows.sparkSession.sparkContext
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    total = F.sum("n_tokens").alias("total")
    got = rows.agg(total, *[F.sum(F.col("n_tokens") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"a{i}_{j}") for i, j in pairs]).first()
    size = float(got["total"] or 0)
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = (got[f"a{i}_{j}"] or 0) / max(size, 1)
    inverse = np.linalg.inv(gram + max(1e-6 * np.trace(gram), 1e-12) * np.eye(k))
    fit = Fit(floor, cap)

    def totals() -> tuple[np.ndarray, np.ndarray]:
        held = context.broadcast(fit)

        def run(batches):
            for b in batches:
                p, n = b[[f"p{i}" for i in range(k)]].to_numpy(), b["n_tokens"].to_numpy(float)
                r, y = held.value.rates(p)
                yield pd.DataFrame([[*(p.T @ (n * r)), *(p.T @ (n * y))]], columns=names)

        names = [f"r{i}" for i in range(k)] + [f"y{i}" for i in range(k)]
        sums = rows.mapInPandas(run, ", ".join(f"{x} double" for x in names)).agg(*[F.sum(x) for x in names]).first()
        held.unpersist()
        values = np.array([x or 0.0 for x in sums])
        return values[:k], values[k:]

    if not size:
        return fit, np.zeros(k)
    for _ in range(steps):
        reached, ahead = totals()
        gap = reached - targets
        if np.abs(gap).max() <= TOLERANCE * size or (len(fit.history) >= 8 and np.abs(last - reached).max() <= STALL * size):  # noqa: F821
            break
        last = reached
        fit.history.append(inverse @ (ahead - targets) / size)
    return fit, reached


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], growth: float = 1.0, floor: float = 0.0, cap: float = CAP, seed: int = 42, key: tuple[str, ...] = (), fit_on: DataFrame | None = None) -> DataFrame:
    """doc_id, key (long columns of docs), n_tokens, the posterior of each domain (p_<name>), rate, copies.

    domains: doc_id and domain of labelled rows, whose texts are read from fit_on, or else from docs; targets: the share of tokens that each domain is to have, scaled to a
    sum of 1; the mixture is to have growth times the tokens of docs. copies is the rate rounded up or down at random,
    by a hash of the id and key, so that its expectation is the rate. Where the targets are out of reach within floor and cap,
    the rates are those of the least squares. Null texts have no tokens and count for nothing; rows of equal text and
    repeated rows get equal rates; an empty table gives no rows; without labels the posteriors are equal.
    """
    names = tuple(sorted(targets))
    rows = texts(docs, key=key)
    model = fit_classifier(rows if fit_on is None else texts(fit_on), domains.where(F.col("domain").isin(*names)), names)
    members = cut(memberships(rows, model, key))
    size = members.agg(F.sum("n_tokens")).first()[0] or 0
    share = np.array([targets[n] for n in names], float)
    fit, _ = fit_rates(members, growth * size * share / share.sum(), floor, cap)
    held, k = rows.sparkSession.sparkContext.broadcast(fit), len(names)

    def run(batches):
        for b in batches:
            b["rate"] = held.value.rates(b[[f"p{i}" for i in range(k)]].to_numpy())[0]
            yield b

    rated = members.mapInPandas(run, ", ".join([f"{c} long" for c in ("doc_id", *key, "n_tokens")] + [f"p{i} double" for i in range(k)] + ["rate double"]))
    chance = F.pmod(F.xxhash64("doc_id", *key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rated.select("doc_id", *key, "n_tokens", *[F.col(f"p{i}").alias(f"p_{n}") for i, n in enumerate(names)], "rate", copies.alias("copies"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), labelled(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)
