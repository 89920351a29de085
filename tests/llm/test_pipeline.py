"""The pipeline against the stages' brute force, and the registered queries' columns."""

import glob
import random

import corpus_pipeline
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from tessera.llm import byte_bpe, common, queries, stages

from .conftest import prose, table
from .test_exact import exact_reference, simhash_reference
from .test_models import junk


def written(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, junk(rng, i) if i % 10 == 0 else prose(rng, rng.choice([60, 90, 200])), "en", f"s{i % 2}", 0) for i in range(240)]
    rows += [(1_000 + i, rows[i][1] + " ", "en", "s0", 0) for i in (1, 2, 3)]
    rows += [(2_000 + i, rows[i][1].replace(rows[i][1].split()[5], "changed", 1), "en", "s1", 0) for i in (4, 5, 6)] + [(3_000, None, None, None, None), (3_001, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 0), int(i % 20 == 1)) for i in range(0, 240, 2)] + [(i, 1, 1) for i in range(1, 240, 20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = written(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {(r.doc_id, r.text) for r in stages.quality(spark, docs, str(tmp_path)).collect()}
    assert {i for i, _ in want} >= {r[0] for r in rows if r[0] < 240 and r[0] % 10} and not {i for i, _ in want} & {r[0] for r in rows if r[0] < 240 and r[0] % 10 == 0}
    kept = {i for i, _, _, k in exact_reference(sorted(want)) if k}
    left = [(i, t) for i, t in sorted(want) if i in kept]
    first = {i for i, _, c in simhash_reference(left) if i == c}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.Codec(f.read()).ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == first
    assert {(r.doc_id, r.n_tokens) for r in got} == {(i, len(enc.encode_ordinary(t))) for i, t in left if i in first}


def test_stages_keep_the_columns(spark, tmp_path):
    written(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, str(tmp_path)).columns == docs.columns, name
    mixed = stages.mixed(spark, docs, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_on_empty_tables(spark, tmp_path):
    written(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs, str(tmp_path)).count() == 0, name


def test_stages_write_small_row_groups(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(48):x}" for _ in range(300)), "en", "s0", 0) for i in range(2_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(groups(f"{tmp_path}/documents.parquet")) == 1
    monkeypatch.setattr(common, "ROW_GROUP_BYTES", 1 << 20, raising=False)
    spark.conf.unset("parquet.block.size")
    try:
        for name, f in corpus_pipeline.STAGES[1:4]:
            f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{f.__name__}")
            assert 0 < max(groups(f"{tmp_path}/out-{f.__name__}")) < 2 << 20, name
            spark.conf.unset("parquet.block.size")
        spark.conf.set("parquet.block.size", "33554432")
        stages.exact(spark, docs, str(tmp_path))
        assert spark.conf.get("parquet.block.size") == "33554432"
    finally:
        spark.conf.unset("parquet.block.size")


def groups(folder):
    """Compressed bytes of each row group of a written table."""
    files = [pq.ParquetFile(p).metadata for p in glob.glob(f"{folder}/*.parquet")]
    return [sum(m.row_group(i).column(c).total_compressed_size for c in range(m.num_columns)) for m in files for i in range(m.num_row_groups)]


def test_without_beyond_the_broadcast_limit(spark):
    from tessera.llm.common import without

    docs = table(spark, [(i, "x") for i in range(10)])
    ids = spark.range(3).toDF("id")
    for limit in (10, 0):
        assert sorted(r.doc_id for r in without(docs, ids, limit).collect()) == list(range(3, 10))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
