"""Every query of the catalogue against its oracle, on the smallest tables."""

import math
import os

import duckdb
import pytest
from tessera.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert cols == sorted(rel.columns)
    got = sorted([[plain(r[c]) for c in cols] for r in df.collect()], key=repr)
    want = sorted([[plain(v) for v in r] for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()], key=repr)
    assert got == want


@pytest.mark.parametrize("odd", ["taken ids", "repeated rows", "null key"])
@pytest.mark.parametrize("name", ["upsert_cards", "upsert_cards_force"])
def test_upsert_on_other_parts(spark, tmp_path, name, odd):
    """A hundred parts and as many whose keys new rows have too, or that come twice, or one without a key."""
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").where("p_partkey <= 100")
    more = {"taken ids": parts.selectExpr("p_partkey + 100000 AS p_partkey", "* EXCEPT (p_partkey)"), "repeated rows": parts, "null key": parts.limit(1).selectExpr("CAST(NULL AS BIGINT) AS p_partkey", "* EXCEPT (p_partkey)")}
    parts.unionByName(more[odd]).write.parquet(f"{tmp_path}/part.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    own = duckdb.connect()
    own.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = own.sql(registry.ORACLES[name]).project(", ".join(df.columns)).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_ivf_recall(spark):
    assert registry.QUERIES["vec_topk_ivf"](spark, FOLDER).first().recall > 0.5


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
