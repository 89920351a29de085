"""Golden vectors of the column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import decide, geometry, hashing, text, vectors


def column(spark, values, schema, c):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {schema}").select(c).collect()]


LINES = [
    ("158/244 R 4 TNE+EN", "multiline", "158", "TNE"), ("188/244 R UNF + EN", "multiline", "188", "UNF"), ("158/244 R UNF XEN", "multiline", "158", "UNF"), ("188/244 R TDMX", "multiline", "188", "DMX"), ("12/34 R PLIST EN", "multiline", "12", "IST"),
    ("0270 R TDM", "with_rarity", "0270", "TDM"), ("357/291 * DSK", "separator", "357", "DSK"), ("123 • NEO", "separator", "123", "NEO"), ("0270 TDM", "space", "0270", "TDM"), ("123/280 NEO", "space", "123", "NEO"), ("123a/280 NEO", "space", "123a", "NEO"),
    ("7/280", "number_only", "7", None), ("7 NEO", "number_only", "7", None), ("123/280", "number_only", "123", None), ("abc", None, None, None), ("", None, None, None), (None, None, None, None),
]


def test_collector_lines(spark):
    got = column(spark, [x[0] for x in LINES], "string", text.collector_line(F.col("v")))
    assert [(r.pattern, r.number, r.set_code) for r in got] == [x[1:] for x in LINES]


def test_file_names(spark):
    names = ["357_The Mindskinner_e5a967e3b23b.jpg", "x/A-130_A-Armory Veteran_0123456789abcd.png", "some-name_NEO-12.jpg", "NEO123.jpg", "just_a-name.webp"]
    got = column(spark, names, "string", text.file_name_parts(F.col("v")))
    assert [tuple(r) for r in got] == [("The Mindskinner", None, "357"), ("A-Armory Veteran", None, "A-130"), ("some name", "NEO", "12"), (None, "NEO", "123"), ("just a name", None, None)]


def test_substitutions_come_in_order(spark):
    got = column(spark, ["NE0"], "string", text.substitutions(F.col("v")))[0]
    assert [r.variant for r in got] == ["NE0", "NEO", "NED", "NEQ"]


def test_hashes(spark):
    hexes = ["a1b2c3d4e5f60718", "1234567890abcdef", "ffffffffffffffff", "0000000000000000"]
    assert column(spark, hexes, "string", hashing.hash_to_hex(hashing.hex_to_hash(F.col("v")))) == hexes
    q = hashing.hex_to_hash(F.lit("1234567890abcdef"))
    assert column(spark, ["1234567890abcdef", "1234567890abcdff", "1234567890abcdee", "0000000000000000"], "string", hashing.hamming(hashing.hex_to_hash(F.col("v")), q)) == [0, 1, 1, 32]


@pytest.mark.parametrize("d, want", [((0, 0, 0), 1.0), ((64, 64, 64), 0.0), ((10, 5, 2), 0.8796875), ((None, None, None), 0.0), ((70, 0, 0), 0.4)])
def test_combined_distances(spark, d, want):
    got = spark.createDataFrame([d], "a int, b int, c int").select(hashing.combine_distances(F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert abs(got - want) < 1e-12


def test_keypoint_bands(spark):
    got = column(spark, [0.6, 0.5, 0.4, 0.3, 0.0, None], "double", decide.keypoint_score(F.lit(0.8), F.col("v")))
    assert np.allclose(got, [1.0, 0.92, 0.896, 0.76, 0.76, 0.8])


@pytest.mark.parametrize("s, gap, unclear", [([0.9], 1.0, False), ([0.9, 0.7], 0.2, False), ([0.95, 0.90], 0.05, True), ([0.95, 0.80, 0.70], 0.15, False), ([0.95, 0.94, 0.93], 0.01, True)])
def test_clarity(spark, s, gap, unclear):
    r = spark.createDataFrame([tuple(s + [None] * (3 - len(s)))], "a double, b double, c double").select(decide.clarity(F.col("a"), F.col("b")), decide.ambiguous(F.col("a"), F.col("b"), F.col("c"))).first()
    assert abs(r[0] - gap) < 1e-9 and r[1] == unclear


def test_finishes(spark):
    raw = ["nonfoil", "non-foil", "NF", "foil", "Surge Foil", "etched foil", "", None, "other"]
    assert column(spark, raw, "string", decide.market_finish(F.col("v"))) == ["NF", "NF", "NF", "FO", "FO", "EF", "NF", "NF", "NF"]


def test_composite_falls_back_to_the_full_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], None), ([3.0, 4.0], [0.0, 2.0], [1.0, 0.0]), ([0.0, 0.0], [0.0, 0.0], [0.0, 0.0])], "f array<double>, c array<double>, n array<double>")
    a, b, z = [r[0] for r in df.select(vectors.composite(F.col("f"), F.col("c"), F.col("n"))).collect()]
    want = 0.7 * np.array([0.6, 0.8]) + 0.2 * np.array([0, 1]) + 0.1 * np.array([1, 0])
    assert np.allclose(a, [0.6, 0.8]) and np.allclose(b, want / np.linalg.norm(want)) and z == [0.0, 0.0]


def test_dimension_check(spark):
    df = spark.createDataFrame([([1.0],)], "v array<double>")
    with pytest.raises(Exception, match="dimension"):
        df.select(vectors.checked(F.col("v"), 2)).collect()


def test_corners_and_lines():
    assert geometry.order_corners([(400, 400), (100, 100), (400, 100), (100, 400)]).tolist() == [[100, 100], [400, 100], [400, 400], [100, 400]]
    assert geometry.line_intersection((0, 0, 2, 2), (0, 2, 2, 0)) == (1, 1)
    assert geometry.line_intersection((0, 0, 1, 0), (0, 1, 1, 1)) is None
    assert np.allclose(geometry.rotate_points([(2, 1)], 90, (1, 1)), [(1, 0)])
    assert geometry.expand_corners([(10, 10), (30, 10), (30, 30), (10, 30)], 0.5, 33, 100).tolist() == [[5, 5], [32, 5], [32, 35], [5, 35]]


def test_pictures():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 256, (504, 363)).astype(np.uint8)
    assert geometry.crop(g, "hash_name").shape == (75, 363) and geometry.crop(g, "hash_collector").shape == (60, 90)
    near = np.clip(g.astype(int) + 2, 0, 255).astype(np.uint8)
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert bits(geometry.dct_hash(g), geometry.dct_hash(near)) <= 6 < bits(geometry.dct_hash(g), geometry.dct_hash(rng.integers(0, 256, (504, 363))))
    assert geometry.difference_hash(np.tile(np.arange(90), (80, 1))) == -1
    with pytest.raises(ValueError, match="too small"):
        geometry.crop(g[:1, :1], "hash_name")
