"""Differences between two copies of a table, found by hierarchical checksums over key ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.runtime import Staging

NULL_MARK, NAN_MARK = -(2**62), 2**62


@dataclass(frozen=True)
class Exact:
    """A field whose values must be equal; null equals only null."""

    name: str

    def fingerprint(self, value: Column) -> Column:
        return F.xxhash64(value)

    def differs(self, left: Column, right: Column) -> Column:
        return ~left.eqNullSafe(right)


@dataclass(frozen=True)
class Vector:
    """A numeric vector compared element by element within ``tolerance``.

    ``sign_free`` vectors equal their negation (quaternions). Null equals only null, NaN only NaN,
    for the whole vector as for its elements; vectors of different length differ.
    """

    name: str
    tolerance: float = 1e-6
    sign_free: bool = False

    def _element_differs(self, a: Column, b: Column) -> Column:
        return (
            F.when(a.isNull() | b.isNull(), ~(a.isNull() & b.isNull()))
            .when(F.isnan(a) | F.isnan(b), ~(F.isnan(a) & F.isnan(b)))
            .when(a == b, F.lit(False))
            .otherwise(F.abs(a - b) > self.tolerance)
        )

    def _elements_differ(self, left: Column, right: Column) -> Column:
        return F.exists(F.zip_with(left, right, self._element_differs), lambda d: d)

    def differs(self, left: Column, right: Column) -> Column:
        unlike = self._elements_differ(left, right)
        if self.sign_free:
            unlike = unlike & self._elements_differ(left, F.transform(right, lambda x: -x))
        return (
            F.when(left.isNull() | right.isNull(), ~(left.isNull() & right.isNull()))
            .when(F.size(left) != F.size(right), F.lit(True))
            .otherwise(unlike)
        )

    def fingerprint(self, value: Column) -> Column:
        """Values further apart than the tolerance never share a fingerprint (they lie several grid
        cells apart); nearer ones nearly always do. So a checksum may be unequal for equal rows, which
        costs one comparison at a leaf, but is never equal for unequal rows, hash collisions aside."""
        cell = self.tolerance / 8
        if self.sign_free:
            first = F.try_element_at(F.filter(value, lambda x: ~F.isnan(x) & (F.abs(x) > self.tolerance)), F.lit(1))
            sign = F.when(first < 0, -1.0).otherwise(1.0)
            value = F.transform(value, lambda x: x * sign)

        def grid(x: Column) -> Column:
            return (
                F.when(x.isNull(), F.lit(NULL_MARK))
                .when(F.isnan(x), F.lit(NAN_MARK))
                .when(F.abs(x) < 1e9, F.round(x / cell).cast("long"))
                .otherwise(F.xxhash64(x))
            )

        return F.xxhash64(F.transform(value, grid))


@dataclass(frozen=True)
class Diff:
    """``cells``: (key, field) rows. ``ranges``: the mismatched leaf ranges, with both row counts."""

    cells: DataFrame
    ranges: DataFrame


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: Sequence[Exact | Vector],
    only_left: str = "not_in_right",
    only_right: str = "not_in_left",
    leaf_width: int = 64,
    fanout: int = 4,
) -> Diff:
    """Every cell in which two copies with a unique bigint ``key`` differ.

    Each side is scanned once: a row hash of its fields goes into the checksum (count, xor, sum) of its
    leaf range of ``leaf_width`` keys, combined on the map side. Checksums of wider ranges are sums of
    narrower ones. From the range of all keys down, mismatched ranges are split into ``fanout`` parts
    and only parts that mismatch are followed; rows meet, and fields are compared, only in leaf ranges
    that are still unequal. A key on one side only gives one row with ``only_left`` or ``only_right``.

    Rows with a null key are ignored. Two empty sides give no rows. Columns other than the key and the
    fields are ignored, whatever their names.
    """
    spark = left.sparkSession
    staging = Staging(spark, "diff")
    names = [f.name for f in fields]

    def hashed(df: DataFrame) -> DataFrame:
        row_hash = F.xxhash64(F.col(key).cast("long"), *[f.fingerprint(F.col(f.name)) for f in fields])
        cols = [F.col(n).alias(f"f{i}") for i, n in enumerate(names)]
        leaf = F.floor(F.col(key).cast("long") / F.lit(leaf_width)).cast("long")
        kept = df.filter(F.col(key).isNotNull())
        return staging.write(kept.select(F.col(key).cast("long").alias("k"), leaf.alias("leaf"), row_hash.alias("h"), *cols))

    sides = {"l": hashed(left), "r": hashed(right)}

    def leaf_sums(side: str) -> DataFrame:
        return (
            sides[side]
            .groupBy("leaf")
            .agg(
                F.count(F.lit(1)).alias(f"{side}_n"),
                F.bit_xor("h").alias(f"{side}_x"),
                F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{side}_s"),
            )
        )

    parts = [f"{s}_{p}" for s in "lr" for p in "nxs"]
    sums = staging.write(
        leaf_sums("l").join(leaf_sums("r"), "leaf", "full").select("leaf", *[F.coalesce(p, F.lit(0)).cast("long").alias(p) for p in parts])
    )
    span = sums.agg(F.min("leaf"), F.max("leaf")).first()
    low, high = (span[0] or 0, span[1] or 0)
    depth = 0
    while fanout**depth <= high - low:
        depth += 1

    def level(k: int) -> DataFrame:
        node = F.floor((F.col("leaf") - low) / F.lit(fanout**k)).cast("long")
        if k == 0:
            rolled = sums.withColumn("node", F.col("leaf") - low)
        else:
            rolled = sums.groupBy(node.alias("node")).agg(*[(F.bit_xor(p) if p[-1] == "x" else F.sum(p)).alias(p) for p in parts])
        unequal = (F.col("l_n") != F.col("r_n")) | (F.col("l_x") != F.col("r_x")) | (F.col("l_s") != F.col("r_s"))
        return rolled.filter(unequal)

    mismatched = level(depth)
    for k in range(depth - 1, -1, -1):
        above = mismatched.select(F.col("node").alias("above"))
        mismatched = level(k).join(above, F.floor(F.col("node") / F.lit(fanout)).cast("long") == F.col("above"), "left_semi")
    ranges = staging.write(mismatched.select((F.col("node") + low).alias("leaf"), F.col("l_n").alias("left_rows"), F.col("r_n").alias("right_rows")))

    def at_leaves(side: str) -> DataFrame:
        kept = sides[side].join(ranges.select("leaf"), "leaf", "left_semi")
        return kept.select("k", F.lit(True).alias(f"{side}_here"), *[F.col(f"f{i}").alias(f"{side}{i}") for i in range(len(names))])

    both = at_leaves("l").join(at_leaves("r"), "k", "full")
    verdicts = F.array(*[F.when(f.differs(F.col(f"l{i}"), F.col(f"r{i}")), F.lit(f.name)) for i, f in enumerate(fields)])
    found = (
        F.when(F.col("r_here").isNull(), F.array(F.lit(only_left)))
        .when(F.col("l_here").isNull(), F.array(F.lit(only_right)))
        .otherwise(F.array_compact(verdicts))
    )
    cells = both.select(F.col("k").alias(key), F.explode(found).alias("field"))
    return Diff(cells, ranges.select((F.col("leaf") * leaf_width).alias("first_key"), ((F.col("leaf") + 1) * leaf_width - 1).alias("last_key"), "left_rows", "right_rows"))
