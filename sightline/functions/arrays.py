"""Vector functions on array columns: distances, normalisations, order statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l1_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def sign_bits(a: Column, n: int) -> Column:
    """Sign bits of the first ``n`` (at most 63) elements as one number."""
    out = F.lit(0).cast("long")
    for i in range(n):
        out = out + F.when(a[i] > 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def root_normalise(a: Column, eps: float = 1e-12) -> Column:
    """Square root of the L1-normalised magnitudes, then L2-normalised."""
    def over(vector: Column, size: Column, step) -> Column:
        """``step(element, size)`` of each element, the size being taken once."""
        bound = F.array(F.struct(vector.alias("a"), size.alias("n")))
        return F.transform(bound, lambda s: F.transform(s["a"], lambda x: step(x, s["n"])))[0]

    l1 = _sum(F.transform(a, lambda x: F.abs(x.cast("double"))))
    rooted = over(a, l1, lambda x, n: F.sqrt(F.abs(x.cast("double")) / (n + eps)))

    def to_unit(r: Column) -> Column:
        return over(r, F.sqrt(_sum(F.transform(r, lambda x: x * x))), lambda x, n: x / (n + eps))

    return F.transform(F.array(rooted), to_unit)[0]


def upper_median(values: Column) -> Column:
    """Element n/2 of the sorted values, which for even n is the upper of the middle two; null if there are none."""
    ordered = F.sort_array(F.array_compact(values))
    return F.try_element_at(ordered, F.floor(F.size(ordered) / F.lit(2)).cast("int") + 1)
