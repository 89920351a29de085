"""Null ids, repeated rows and clashing columns in every operator."""

import public_tokenizers
import pytest
from tessera.llm import byte_bpe, exact_dedup, lm_scoring, mixing, pii, quality_classifier, quality_rules, simhash, substring_dedup, token_output
from tessera.llm.common import NO_ID

from .conftest import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXT = "some words that repeat here and there " * 4
ROWS = [(None, TEXT, None, None, None), (5, TEXT), (7, None), (7, None), (9, "x"), (2**53 + 1, "é́ ퟿ \U0010ffff"), (-4, "\n\n")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (9, 0, 0), (9, 0, 1), (None, 1, 0), (-4, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "mixing": lambda d, k, p: mixing.mix(d, mixing.labelled(k), mixing.TARGETS),
    "token_output": lambda d, k, p: (token_output.write_ids(d, f"file://{p}/x", public_tokenizers.path("byte_bpe_50k.json")), token_output.read_ids(d.sparkSession, f"file://{p}/x"))[1],
    "quality_rules": lambda d, k, p: quality_rules.quality_rules(d),
    "lm_scoring": lambda d, k, p: lm_scoring.pseudo_likelihood(d),
    "substring_dedup": lambda d, k, p: substring_dedup.dedup_substrings(d),
    "byte_bpe": lambda d, k, p: byte_bpe.digests(d, RANKS),
    "quality_classifier": lambda d, k, p: quality_classifier.quality_scores(d, k),
    "pii": lambda d, k, p: pii.find_pii(d),
    "exact_dedup": lambda d, k, p: exact_dedup.exact_dedup(d),
    "simhash": lambda d, k, p: simhash.simhash_components(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_has_its_row(spark, labels, tmp_path, name):
    got = OPERATORS[name](table(spark, ROWS), labels, tmp_path).collect()
    assert sorted(r.doc_id for r in got) == sorted(NO_ID if r[0] is None else r[0] for r in ROWS)
