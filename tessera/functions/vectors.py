"""Columns over vectors: arrays of numbers, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import CONFIG


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """v at length 1; a zero vector stays as it is."""
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))), 1)


def composite(full: Column, collector: Column, name: Column, config=CONFIG) -> Column:
    """Normalised weighted sum of the normalised parts; the full vector alone where a part is missing."""
    wf, wc, wn = config.composite_weights
    both = F.zip_with(F.zip_with(normalised(full), normalised(collector), lambda x, y: wf * x + wc * y), normalised(name), lambda x, y: x + wn * y)
    return F.when(collector.isNull() | name.isNull(), normalised(full)).otherwise(normalised(both))


def checked(v: Column, dim: int) -> Column:
    """v, or an error where its dimension is another one."""
    return F.when(F.assert_true(F.size(v) == dim, F.lit(f"vector dimension is not {dim}")).isNull(), v)


def l2_score(squared: Column) -> Column:
    return 1.0 / (1.0 + squared)


def half_cosine(cosine: Column) -> Column:
    return (1.0 + cosine) / 2.0
