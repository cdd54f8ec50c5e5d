"""Versioned rows: one current row for each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, version: str, fields: Sequence[str]) -> DataFrame:
    """The row of each ``key`` with the latest ``version``, as ``key, version, *fields``.

    Rows with a null key are left out, a null version is the oldest, and of different rows with the
    same version the largest by ``fields`` is taken, so the result does not depend on row order. The
    maximum is combined on the map side, so a key with very many versions moves one row per task.
    Other columns of ``df`` are ignored, whatever their names.
    """
    packed = F.struct(F.col(version).alias("v"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("k"))
        .agg(F.max(packed).alias("r"))
        .select(F.col("k").alias(key), F.col("r.v").alias(version), *[F.col(f"r.f{i}").alias(f) for i, f in enumerate(fields)])
    )
