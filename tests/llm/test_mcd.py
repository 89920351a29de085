"""Robust estimates against numpy: the same concentration, reweighting and shrinkage, row by row."""

import math

import numpy as np
from pyspark.sql import functions as F
from tessera.llm import quality_rules as q

from .conftest import prose, table
from .test_models import junk


def concentrated(x, mean, cov):
    det = np.linalg.slogdet(cov)[1]
    for _ in range(q.STEPS):
        d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        core = d <= np.sort(d)[math.ceil(q.CORE * len(x)) - 1]
        mean, cov = x[core].mean(0), q.CORE_FACTOR * np.cov(x[core].T, bias=True) + q.RIDGE * np.eye(q.P)
        det, was = np.linalg.slogdet(cov)[1], det
        if abs(det - was) < 1e-9:
            break
    return np.linalg.slogdet(cov)[1], mean, cov


def estimate(x):
    """n, mean and covariance after reweighting."""
    middle = np.sort(x, 0)[(len(x) - 1) // 2]
    scale = 1.4826 * np.sort(np.abs(x - middle), 0)[(len(x) - 1) // 2]
    starts = [(x.mean(0), np.cov(x.T, bias=True) + q.RIDGE * np.eye(q.P)), (middle, np.diag(scale**2) + q.RIDGE * np.eye(q.P))]
    _, mean, cov = min((concentrated(x, *s) for s in starts), key=lambda r: r[0])
    near = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean) <= q.REWEIGHT
    return near.sum(), x[near].mean(0), np.cov(x[near].T, bias=True)


def shrunk(own, parent):
    n, m, c = own
    w, gap = n / (n + q.SHRINK), m - parent[1]
    return n, w * m + (1 - w) * parent[1], w * c + (1 - w) * parent[2] + w * (1 - w) * np.outer(gap, gap)


def test_estimates_equal_numpy(spark):
    rng = np.random.default_rng(2)
    parts = {"a": rng.normal(size=(400, 5)) * [1, 2, 0.5, 1, 3], "b": rng.normal(size=(61, 5)) @ rng.normal(size=(5, 5)), "c": rng.normal(size=(7, 5))}
    parts["a"][:60] += 40
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in parts.items() for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(5)))
    got = {r["grp"]: r for r in q.mcd_moments(rows).collect()}
    for g, x in parts.items():
        n, mean, cov = estimate(x)
        assert got[g]["n"] == n
        assert np.allclose([got[g][f"m{i}"] for i in range(5)], mean)
        assert np.allclose([got[g][f"c{i}{j}"] for i, j in q.LOWER], [cov[i, j] for i, j in q.LOWER])


def test_verdicts_equal_numpy(spark):
    import random

    rng = random.Random(13)
    docs = []
    for i in range(420):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["hot"] * 9 + ["s1", "s2", f"tiny{i % 5}"])
        docs.append((i, junk(rng, i) if i % 8 == 0 else prose(rng, rng.choice([55, 100, 300])), lang, source, 0))
    df = table(spark, docs)
    stats = q._vectors(q.statistics(df)).collect()
    verdicts = {r.doc_id: r for r in q.quality_rules(df).collect()}
    ok = [r for r in stats if not verdicts[r.doc_id].base_failed]
    x = {r.doc_id: np.array([r[f"x{i}"] for i in range(5)]) for r in ok}
    of = lambda keep: estimate(np.array([x[r.doc_id] for r in ok if keep(r)]))
    top = of(lambda r: True)
    languages = {k: shrunk(of(lambda r: r.lang == k), top) for k in {r.lang for r in ok}}  # noqa: B023
    rejected = 0
    for k in {(r.lang, r.source) for r in ok}:
        _, mean, cov = shrunk(of(lambda r: (r.lang, r.source) == k), languages[k[0]])  # noqa: B023
        for r in ok:
            if (r.lang, r.source) == k:
                gap = x[r.doc_id] - mean
                d = gap @ np.linalg.solve(cov + q.RIDGE * np.eye(5), gap)
                assert abs(verdicts[r.doc_id].distance2 - d) < 2e-3 * max(1, d)
                assert verdicts[r.doc_id].kept == (d <= q.CUTOFF) or abs(d - q.CUTOFF) < 1e-2
                rejected += not verdicts[r.doc_id].kept
    assert rejected > 10


def test_chi_squared():
    assert abs(q.chi_squared_tail(12.8325, 5) - 0.025) < 1e-5 and abs(q.chi_squared_quantile(0.5, 7) - 6.3458) < 1e-3


def test_no_python_in_the_plan(spark):
    rows = table(spark, [(i, prose(__import__("random").Random(i), 60)) for i in range(8)])
    plan = q.quality_rules(rows.select("doc_id", "text", "lang", F.lit("s").alias("source")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_tables_of_groups_take_few_files(spark, monkeypatch):
    """What there is once a group and step is not written as one file for each shuffle partition; the estimates stay."""
    rng = np.random.default_rng(5)
    x = {g: rng.normal(size=(60, 5)) for g in "abc"}
    rows = spark.createDataFrame([(g, *map(float, r)) for g, t in x.items() for r in t], "grp string, " + ", ".join(f"x{i} double" for i in range(5)))
    files = []
    real = q.cut
    monkeypatch.setattr(q, "cut", lambda df: files.append((out := real(df)).rdd.getNumPartitions()) or out)
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = {r.grp: r for r in q.mcd_moments(rows).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(files) > 3 and sum(n > 1 for n in files) <= 1  # the medians alone, which tell how many groups there are
    for g, t in x.items():
        n, mean, _ = estimate(t)
        assert got[g].n == n and np.allclose([got[g][f"m{i}"] for i in range(5)], mean)
