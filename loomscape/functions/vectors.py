"""Column expressions of signatures, descriptors and bit lanes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l1_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference; 1 where lengths differ or nothing is there."""
    n = F.size(a)
    bad = a.isNull() | b.isNull() | (n != F.size(b)) | (n < 1)
    return F.when(bad, 1.0).otherwise(total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / n)


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of integer descriptors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Differing bits over lanes of 64."""
    return reduce(lambda s, x: s + x, (F.bit_count(x.bitwiseXOR(y)).cast("long") for x, y in zip(a, b, strict=True)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return (0.2126 * r + 0.7152 * g + 0.0722 * b) / 255.0


def upper_median(values: Column) -> Column:
    """The middle of an array, the upper one of two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))
