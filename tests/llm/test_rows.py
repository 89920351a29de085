"""The pipeline's stages on null and repeated doc_ids: a verdict is a row's own."""

import random
from collections import Counter

from tessera.llm import stages

from .conftest import prose, table


def counted(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def some(n, words=90, seed=5):
    rng = random.Random(seed)
    return [prose(rng, words) for _ in range(n)]


def test_quality_judges_rows_of_one_id_apart(spark):
    a, b, c, d, e = some(5)
    good = [(None, a), (None, b), (7, c), (7, d), (9, e), (9, e)]
    got = counted(stages.quality(spark, table(spark, [*good, (None, "too short"), (7, "short as well")]), ""))
    assert got == Counter(good)


def test_exact_keeps_one_row_of_each_text(spark):
    a, b, c, d, e = some(5)
    rows = [(None, a), (None, a + " "), (None, b), (7, c), (7, d), (3, d), (9, e), (9, e), (9, e), (None, None), (None, None)]
    assert counted(stages.exact(spark, table(spark, rows), "")) == Counter([(None, a + " "), (None, b), (7, c), (3, d), (9, e), (None, None)])


def test_near_keeps_one_row_of_each_component(spark):
    a, b, c, d, e = some(5, 400)
    near = lambda t: t.upper()  # noqa: E731, shingles are of lower case
    rows = [(None, a), (None, near(a)), (None, b), (7, c), (7, d), (3, near(d)), (9, e), (9, e)]
    got = counted(stages.near(spark, table(spark, rows), ""))
    assert got in [Counter([(None, x), (None, b), (7, c), (3, near(d)), (9, e)]) for x in (a, near(a))]


def test_kept_rows_beyond_the_broadcast_limit(spark):
    from tessera.llm.common import ROW, kept_rows, with_row

    docs = with_row(table(spark, [(None, "a"), (None, "b"), (1, "c"), (1, "c")]))
    verdicts = docs.selectExpr(*ROW, "text <> 'a' AS kept")
    for limit in (10, 0):
        assert counted(kept_rows(docs, verdicts, True, limit)) == Counter([(None, "b"), (1, "c")])
        assert counted(kept_rows(docs, verdicts, False, limit)) == Counter({(None, "b"): 1, (1, "c"): 2})


def test_mixing_copies_rows_and_not_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "PIPELINE_GROWTH", 2.0)
    a, b, c = some(3)
    many = some(40, 60, 6)
    rows = [(7, a), (7, a), (8, b), (8, c), *[(None, t) for t in many]]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # without labels all posteriors and so all rates are equal: twice the tokens are two copies of each row
    assert counted(stages.mixed(spark, docs, str(tmp_path))) == Counter({k: 2 * n for k, n in Counter(rows).items()})


def test_mixing_rounds_rows_of_one_id_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "PIPELINE_GROWTH", 1.5)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, [(None, t) for t in some(200, 60, 6)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert 250 < stages.mixed(spark, docs, str(tmp_path)).count() < 350


def test_mixing_learns_from_rows_that_earlier_stages_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stages, "PIPELINE_TARGETS", {"good": 0.1, "poor": 0.9, "toxic": 0.0})
    monkeypatch.setattr(stages, "PIPELINE_GROWTH", 2.0)
    good, poor = some(60, 60, 8), [t.replace(" ", " buy ") for t in some(60, 60, 9)]
    rows = [*enumerate(good), *enumerate(poor, 100)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = table(spark, [r for r in rows if r[0] % 2])  # none of them is labelled
    got = counted(stages.mixed(spark, left, str(tmp_path)))
    of = lambda low, high: sum(n for (i, _), n in got.items() if low <= i < high)
    assert of(100, 200) > 1.2 * of(0, 100)


def test_substrings_of_rows_that_share_an_id(spark):
    import hashlib

    from tessera.llm import substring_dedup

    sha = lambda words: hashlib.sha256(" ".join(words).encode()).hexdigest()
    shared = [f"s{k}" for k in range(30)]
    first, second = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(50)]
    rows = [(1, " ".join(shared)), (2, " ".join([*shared, "x", "y", "z"])), (2, " ".join(second)), (None, " ".join(first)), (None, " ".join(second)), (None, None), (7, " ".join(shared[:25])), (7, " ".join(shared[:25]))]
    got = Counter((r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(table(spark, rows).repartition(4)).collect())
    # a null id is the smallest one, so second's words stay there; rows of equal id and text are one document
    assert got == Counter([(30, 0, sha(shared)), (33, 30, sha("xyz")), (50, 50, sha([])), (40, 0, sha(first)), (50, 0, sha(second)), (0, 0, sha([])), (25, 25, sha([])), (25, 25, sha([]))])


def test_substrings_do_not_depend_on_where_a_chunk_begins(spark, monkeypatch):
    from tessera.llm import substring_dedup

    rng = random.Random(21)
    passages = [prose(rng, 20).split() for _ in range(60)]
    rows = [(k, " ".join(p)) for k, p in enumerate(passages)] + [(100 + k, " ".join([*prose(rng, 9).split(), *p, "end"])) for k, p in enumerate(passages)]
    for chars in (1, 10**6):  # every text at a chunk's start, or only the first one of a batch
        monkeypatch.setattr(substring_dedup, "CHUNK_CHARS", chars)
        got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(table(spark, rows).coalesce(1)).collect()}
        assert got == {k: 0 if k < 100 else 20 for k, _ in rows}


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    from tessera.llm import exact_dedup

    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (2, "ab"), (None, "c"), (None, "c"), (None, "d"), (5, None), (5, "")]
    got = exact_dedup.exact_dedup(table(spark, rows).repartition(3)).collect()
    assert Counter((r.keep_id, r.group_size, r.kept) for r in got if r.doc_id in (1, 2)) == Counter({(1, 4, True): 1, (1, 4, False): 3})
    assert Counter((r.group_size, r.kept) for r in got if r.doc_id not in (1, 2)) == Counter([(2, True), (2, False), (1, True), (2, True), (2, False)])
