"""Columns over 64-bit hashes, kept as signed longs with a 16-digit hex view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import CONFIG


def hex_to_hash(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("bigint")


def hash_to_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


def median_bits(values: Column) -> Column:
    """The hash with bit i set where element i is above the median, first element highest: 64 elements."""
    ordered = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    middle = (F.get(ordered, F.lit(31)) + F.get(ordered, F.lit(32))) / 2
    bits = F.element_at(F.transform(F.array(middle), lambda m: F.array_join(F.transform(values, lambda x: F.when(x.cast("double") > m, "1").otherwise("0")), "")), 1)
    return F.conv(bits, 2, -10).cast("bigint")


def combine_distances(full: Column, name: Column, collector: Column, config=CONFIG) -> Column:
    """Weighted similarity of three hash distances in [0, 1]; a missing variant counts as the largest distance."""
    most = float(config.hash_bits)
    part = lambda d, w: w * (1.0 - F.least(F.coalesce(d.cast("double"), F.lit(most)) / most, F.lit(1.0)))
    return sum((part(d, w) for d, w in zip((full, name, collector), config.hash_weights)), F.lit(0.0))
