"""The clustered index: results, and their recall, recounted here, of at least 0.9."""

import os

import pytest
from tessera.config import CONFIG
from tessera.operators import retrieve
from tessera.plans import registry
from tessera.plans import standins as S

FOLDERS = [os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"), "/root/testdata/sf0.1"]


@pytest.mark.parametrize("folder", FOLDERS)
def test_index_finds_nine_in_ten(spark, folder):
    got = registry.QUERIES["vec_topk_ivf"](spark, folder).collect()
    v = S.vectors(spark, folder).select("card_id", "embedding")
    exact = {(r.query_id, r.card_id) for r in retrieve.top_k(S.queries(v), v).select("query_id", "card_id").collect()}
    share = len({(r.query_id, r.card_id) for r in got} & exact) / len(exact)
    print(folder, "recall", share, "rows", len(got))
    assert share >= 0.9 and all(abs(r.recall - share) < 1e-3 for r in got)
    assert len(got) == len(exact) and {r.rank for r in got} == set(range(1, CONFIG.top_k + 1))


def test_probes_make_no_row_for_a_pair(spark, monkeypatch):
    """Against numpy over the probed lists, in blocks of queries and of scores, with copies, zeros and lists without queries."""
    import numpy as np
    from tessera.operators import ann

    monkeypatch.setattr(ann, "BLOCK_QUERIES", 17)
    monkeypatch.setattr(retrieve, "CELLS", 500)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x[200:300], x[300] = x[100], 0.0
    centres = rng.normal(size=(6, 8))
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "card_id long, embedding array<double>").repartition(5)
    found = ann.probe(v.where("card_id % 10 = 0").withColumnRenamed("card_id", "query_id"), ann.assign_lists(v, centres), centres, 7, 2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    order = np.argsort(-(x @ centres.T), axis=1, kind="stable")
    want = set()
    for i in range(0, 600, 10):
        s = np.round(unit @ unit[i], 12)
        own = [j for j in range(600) if j != i and order[j, 0] in order[i, :2]]
        want |= {(i, j, n + 1, round(float(s[j]), 9) + 0.0) for n, j in enumerate(sorted(own, key=lambda j: (-s[j], j))[:7])}
    assert {(r.query_id, r.card_id, r["rank"], round(r.score, 9) + 0.0) for r in found.collect()} == want
