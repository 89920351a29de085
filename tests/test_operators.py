"""Operators against brute force and small scenarios."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.config import EngineConfig
from tessera.functions import geometry
from tessera.operators import ann, batch, catalog, evaluate, market, rerank, resolve, retrieve
from tessera.sources import files, sinks
from tessera.streaming import ingest

CODES = ["TDM", "NEO", "DMR", "ONE", "BRO", "MOM", "WOE", "LCI", "MKM", "OTJ"]


@pytest.fixture(scope="module")
def index(spark):
    x = np.random.default_rng(5).normal(size=(300, 16))
    df = spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "card_id long, label int, embedding array<double>").repartition(4)
    return df.cache(), x


@pytest.mark.parametrize("metric", ["cosine", "half_cosine", "inner", "l2"])
@pytest.mark.parametrize("block", [7, 4096])
def test_top_k(index, metric, block):
    df, x = index
    got = retrieve.top_k(df.where("card_id % 10 = 0").withColumnRenamed("card_id", "query_id"), df, 5, metric, block=block).collect()
    s = retrieve._scores(x, x, metric)
    np.fill_diagonal(s, -np.inf)
    assert {(r.query_id, r.rank): r.card_id for r in got} == {(q, k + 1): int(c) for q in range(0, 300, 10) for k, c in enumerate(np.argsort(-s[q], kind="stable")[:5])}


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "card_id long, embedding array<double>").repartition(3)
    got = retrieve.top_k(df.where("card_id = 9").withColumnRenamed("card_id", "query_id"), df, 3).orderBy("rank").collect()
    assert [r.card_id for r in got] == [0, 1, 2]


def test_all_lists_equal_exact(index):
    df, _ = index
    centres = ann.fit_lists(df, 8)
    q = df.where("card_id % 10 = 0").withColumnRenamed("card_id", "query_id")
    exact = retrieve.top_k(q, df, 5)
    key = lambda d: {(r.query_id, r.card_id, r.rank) for r in d.collect()}
    assert key(ann.probe(q, ann.assign_lists(df, centres), centres, 5, 8)) == key(exact)
    assert ann.recall(ann.probe(q, ann.assign_lists(df, centres), centres, 5, 3), exact).first().recall > 0.4


@pytest.mark.parametrize("most", [0, 1, 3, 7])
def test_banded_join_equals_brute_force(spark, most):
    rng = np.random.default_rng(most)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    h = np.concatenate([base, base ^ (1 << rng.integers(0, 62, 60)), base ^ (7 << rng.integers(0, 60, 60))])
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(h)], "id long, hash long")
    got = {(r.left_id, r.right_id, r.distance) for r in retrieve.hamming_join(df, df, most).collect()}
    d = np.bitwise_count(h[:, None].view(np.uint64) ^ h[None, :].view(np.uint64))
    assert got == {(int(i), int(j), int(d[i, j])) for i, j in zip(*np.nonzero(d <= most))}
    with pytest.raises(ValueError, match="bands"):
        retrieve.hamming_join(df, df, 8)


def rows(spark, scores):
    return spark.createDataFrame([(1, i, s, i) for i, s in enumerate(scores, 1)], "query_id long, card_id long, score double, rank int")


def test_resort_only_after_a_boost(spark):
    r = rows(spark, [0.9, 0.89, 0.5])
    similarity = F.when(F.col("card_id") == 1, 0.1)
    ranks = lambda c: [x.card_id for x in rerank.keypoints(r, similarity, c).orderBy("rank").collect()]
    assert ranks(EngineConfig()) == [2, 1, 3]
    assert ranks(EngineConfig(resort_on_boost_only=True)) == [1, 2, 3]


def test_injected_card_wins_ties(spark):
    out = rerank.inject(rows(spark, [0.95, 0.8]), spark.createDataFrame([(1, 77)], "query_id long, card_id long"))
    assert rerank.decisions(out).first().decision == "ocr_triangulation"
    again = rerank.inject(rows(spark, [0.95, 0.8]), spark.createDataFrame([(1, 2)], "query_id long, card_id long")).orderBy("rank").collect()
    assert [(r.card_id, r.score) for r in again] == [(2, 1.0), (1, 0.95)]


def test_fuzzy_codes(spark):
    want = {"TDM": "TDM", "TOM": "TDM", "NE0": "NEO", "0NE": "ONE", "BR0": "BRO", "M0M": "MOM", "W0E": "WOE", "LCl": "LCI", "MKN": "MKM", "XYZ": None, "AB": None, "OM": "MOM", "L0I": "LCI", "MOE": "MOM", "": None}
    raw = spark.createDataFrame([(k, k) for k in want], "key string, code string")
    got = {r.key: r.set_code for r in resolve.fuzzy_codes(raw, spark.createDataFrame([(c,) for c in CODES], "set_code string")).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_code_in_text(spark):
    got = resolve.code_in_text(spark.createDataFrame([(1, "TOM EN FILIP"), (2, "xx yy")], "key long, text string"), spark.createDataFrame([("TDM",), ("NEO",)], "c string")).collect()
    assert [tuple(r) for r in got] == [(1, "TDM")]


def test_metrics_of_the_five_list(spark):
    p = spark.createDataFrame([("a", "x", 0.9, 1.0, ["y", "x"]), ("b", "m", 0.9, 1.0, ["n", "g"]), ("c", "g", 0.1, 1.0, []), ("d", "", 0.5, 1.0, ["q"] * 5 + ["g"]), ("e", "z", 0.9, 1.0, None)], "path string, match_id string, confidence double, seconds double, candidates array<string>")
    g = spark.createDataFrame([("a", "x"), ("b", "g"), ("c", "g"), ("d", "g")], "path string, gold_id string")
    m = evaluate.metrics(p, g).first()
    assert (m.n, m.precision_at_1, m.precision_at_5, m.high_count, m.high_accuracy) == (4, 0.5, 0.75, 2, 0.5)
    assert abs(m.mrr - (1 / 2 + 1 / 3 + 1) / 4) < 1e-12
    assert [r.gold_rank for r in evaluate.error_report(p, g).collect()] == [2, 6]
    none = evaluate.metrics(p, g.where("false")).first()
    assert (none.n, none.mrr, none.high_accuracy) == (0, 0.0, 0.0)


def test_predictions_file(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text('scanned_path,match_card_id,matched_card_id,confidence,candidates,processing_time\na,,m,0.5,"[""x"",""y""]",1\nb,k,,bad,"[{""card_id"":""z""}]",\na,q,,0.7,broken,2\n')
    got = {r.path: r for r in files.predictions(spark, str(f)).collect()}
    assert (got["a"].match_id, got["a"].confidence, got["a"].candidates) == ("q", 0.7, [])
    assert (got["b"].match_id, got["b"].confidence, got["b"].candidates, got["b"].seconds) == ("k", 0.0, ["z"], 0.0)
    assert files.corrections(spark, str(tmp_path / "none.csv")).count() == 0


def test_expectations_and_regression(spark, tmp_path):
    f = tmp_path / "e.json"
    f.write_text(json.dumps({"a.jpg": {"card_name": "A", "confidence": 1.0}, "b.jpg": {"card_name": "B", "confidence": 0.9}, "c.jpg": {"card_name": "C", "confidence": 0}}))
    r = spark.createDataFrame([("a.jpg", "A", 0.92), ("b.jpg", "B", 0.88), ("c.jpg", "X", 1.0), ("d.jpg", "D", 1.0), ("e.jpg", None, None)], "file string, card_name string, confidence double")
    s = evaluate.regression(r, files.expectations(spark, str(f)))
    assert {x.file: x.status for x in s.collect()} == {"a.jpg": "REGR", "b.jpg": "WARN", "c.jpg": "FAIL", "d.jpg": "NEW", "e.jpg": "NO MATCH"}
    assert tuple(evaluate.regression_summary(s).first()) == (1, 3, 2)


def test_index_round_trip(spark, index, tmp_path):
    df, _ = index
    cards = spark.createDataFrame([(i, "AB"[i % 2], ["foil", "etched", "nonfoil"][i % 3]) for i in range(60)], "card_id long, set_code string, finish string")
    odd = df.select("card_id", F.when(F.col("card_id") == 3, F.array(F.lit(1.0))).otherwise(F.col("embedding")).alias("embedding"))
    rows_ = catalog.index_rows(cards, odd)
    sinks.write_index(rows_, f"{tmp_path}/ix", {"type": "flat"})
    assert rows_.count() == 59 and files.index(spark, f"{tmp_path}/ix", "A", "foil").count() == 20
    assert [r[0] for r in files.indexed_sets(spark, f"{tmp_path}/ix", "nonfoil").collect()] == ["A", "B"]
    assert "PartitionFilters: [isnotnull(set_code" in files.index(spark, f"{tmp_path}/ix", "A")._jdf.queryExecution().toString()
    assert spark.read.json(f"{tmp_path}/ix_manifest").first().dim == 16


def test_bytes_to_vector(spark):
    v = np.array([1.5, -2.25, 0.0, 3e-3, -1e20, 1e-40], "<f4")
    got = spark.createDataFrame([(bytearray(v.tobytes()),)], "b binary").select(files.vector_from_bytes(F.col("b"))).first()[0]
    assert np.array_equal(np.array(got, np.float32), v)


def test_upsert_keeps_ids_and_skips_taken_ones(spark):
    old = spark.createDataFrame([(1, "a", "p1", "s1"), (2, "b", "p2", "s2")], "card_id long, name string, image_path string, source_id string")
    new = spark.createDataFrame([(9, "A", "p1", "x"), (2, "dup", "p3", "x"), (3, "c", "p4", "x"), (3, "d", "p5", "x")], "card_id long, name string, image_path string, source_id string")
    plain = {tuple(r) for r in catalog.upsert(old, new).collect()}
    assert plain == {(1, "a", "p1", "s1"), (2, "b", "p2", "s2"), (3, "c", "p4", "x")}
    assert (1, "A", "p1", "s1") in {tuple(r) for r in catalog.upsert(old, new, force=True).collect()}


def test_corrections_log_and_toggle(spark):
    cards = spark.createDataFrame([(1, "a", "S", "1", "foil"), (2, "a", "S", "1", "nonfoil"), (3, "b", "S", "2", "foil")], "card_id long, name string, set_code string, collector_number string, finish string")
    results = spark.createDataFrame([(10, 1), (11, 3), (12, 2)], "image_id long, matched_card_id long")
    log = spark.createDataFrame([(10, 3, "x", 1), (10, 2, "y", 2)], "image_id long, card_id long, reason string, at long")
    now = batch.corrected(results, log)
    assert {(r.image_id, r.is_corrected, r.corrected_card_id) for r in now.collect()} == {(10, True, 2), (11, False, None), (12, False, None)}
    assert {(r.image_id, r.card_id) for r in batch.toggle_finish(now, cards, "foil").collect()} == {(10, 1), (12, 1)}
    with pytest.raises(ValueError, match="finish"):
        batch.toggle_finish(now, cards, "etched")


def test_unknown_filters_are_refused(spark):
    with pytest.raises(ValueError, match="operator"):
        market.sku_filter(spark.range(1), {"id": "near.3"})
    with pytest.raises(ValueError, match="is takes"):
        market.sku_filter(spark.range(1), {"id": "is.three"})


def test_is_takes_null_and_truth_values(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id long, foil boolean")
    ids = lambda v: sorted(r.id for r in market.sku_filter(df, {"foil": v}).collect())
    assert [ids(v) for v in ("is.null", "not.is.null", "is.true", "not.is.true")] == [[1], [2, 3], [2], [1, 3]]


def test_sidecars_over_file_names(spark, tmp_path):
    (tmp_path / "NEO12.json").write_text(json.dumps({"id": "u1", "name": "Real", "set": "neo", "collector_number": "13", "finishes": ["foil"], "frame_effects": ["showcase"]}))
    folder = f"file:{tmp_path}"
    paths = spark.createDataFrame([(f"{folder}/NEO12.jpg",), (f"{folder}/TDM7.jpg",)], "path string")
    side = files.sidecars(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    got = {r.path.rsplit("/", 1)[1]: r for r in catalog.metadata(paths, side).collect()}
    assert (got["NEO12.jpg"].name, got["NEO12.jpg"].collector_number, got["NEO12.jpg"].variant_type, got["NEO12.jpg"].finish) == ("Real", "13", "showcase", "foil")
    assert (got["TDM7.jpg"].set_code, got["TDM7.jpg"].collector_number, got["TDM7.jpg"].finish) == ("TDM", "7", "nonfoil")


def test_image_folders(spark, tmp_path):
    for p in ("NEO/foil/b.jpg", "NEO/foil/a.PNG", "NEO/foil/x.txt", "TDM/c_foil.jpg", "TDM/d.webp", "TDM/e_nonfoil.jpg"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    names = lambda s, k: [r.path.rsplit("/", 1)[1] for r in files.catalogue_images(spark, str(tmp_path), s, k, False).collect()]
    assert names("NEO", "foil") == ["a.PNG", "b.jpg"]
    assert names("TDM", "foil") == ["c_foil.jpg"] and names("TDM", "nonfoil") == ["d.webp", "e_nonfoil.jpg"]


class Sized:
    def embed(self, images):
        if b"bad" in images:
            raise ValueError("unreadable")
        return np.array([[len(x), 1.0] for x in images])


def test_one_bad_picture_costs_no_other(spark):
    df = spark.createDataFrame([("a", bytearray(b"xxx")), ("b", bytearray(b"bad"))], "path string, content binary")
    got = {r.path: r for r in geometry.embed_images(df, Sized, 2).collect()}
    assert got["b"].error == "unreadable" and got["b"].embedding is None
    assert got["a"].error is None and abs(np.linalg.norm(got["a"].embedding) - 1) < 1e-6


def test_pictures_go_to_the_model_in_groups():
    calls = []

    class Counting(Sized):
        def embed(self, images):
            calls.append(len(images))
            return super().embed(images)

    got = geometry.embed_batch(Counting(), [b"x" * i for i in range(1, 6)] + [b"bad"], 3)
    assert calls == [3, 3, 1, 1, 1]
    assert [v[0] for v in got[:5]] == [1, 2, 3, 4, 5] and str(got[5]) == "unreadable"


def test_triangulation_takes_the_first_of_many_cards(spark):
    cards = spark.createDataFrame([(i, "Common Word", "TST", "7", "foil") for i in range(9, 0, -1)], "card_id long, name string, set_code string, number string, finish string")
    lines = spark.createDataFrame([(1, "common word", None, "7", "foil"), (2, "common thing", "tst", None, "foil"), (3, "none", "X", "1", "foil")], "query_id long, title string, set_code string, number string, finish string")
    assert sorted(map(tuple, resolve.triangulate(lines, cards).select("query_id", "card_id", "level").collect())) == [(1, 1, 4), (2, 1, 3)]


def test_streamed_batches(spark, tmp_path):
    spark.range(30).selectExpr("id", "id * 2 AS v").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.file_stream(spark, f"{tmp_path}/in", "id long, v long", files=1)
    for _ in range(2):
        ingest.process(stream, lambda d: d.withColumn("error", F.lit(None).cast("string")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 30 and got.select("batch_no").distinct().count() == 3


def test_end_to_end_on_five_cards(spark):
    names = ["Lightning Bolt", "Giant Growth", "Counterspell", "Llanowar Elves", "Serra Angel"]
    rng = np.random.default_rng(42)
    e = rng.normal(size=(5, 32))
    cards = spark.createDataFrame([(i, n, "TST", f"{i + 1:03d}", "nonfoil") for i, n in enumerate(names)], "card_id long, name string, set_code string, number string, finish string")
    index = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(e)], "card_id long, embedding array<double>")
    scans = spark.createDataFrame([(100 + i, [float(v) for v in r + rng.normal(0, 0.05, 32)]) for i, r in enumerate(e)], "query_id long, embedding array<double>")
    found = retrieve.top_k(scans, index, 3)
    assert {r.query_id - 100: r.match_card_id for r in rerank.decisions(found).collect()} == {i: i for i in range(5)}
    lines = spark.createDataFrame([(100, "serra angel", "TST", None, "nonfoil")], "query_id long, title string, set_code string, number string, finish string")
    hit = resolve.triangulate(lines, cards)
    assert hit.first().card_id == 4
    top = rerank.decisions(rerank.inject(found, hit)).where("query_id = 100").first()
    assert top.match_card_id in (0, 4)
