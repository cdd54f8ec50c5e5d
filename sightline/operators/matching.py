"""Descriptor matching between the features of view pairs: exact, by blocks, and by cascaded hashes.

Features come as ``view_id, feature_id, vec`` with vectors of one length. Pairs are views i < j, those of a
candidate list ``view_i, view_j`` or all; the query side is i. Rows with a null id or vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.arrays import root_normalise
from sightline.runtime import Staging

BLOCK = 1024
RATIO = 0.8  # fixed value: a match is kept if its distance is below this share of the second best
# Fixed values of the cascaded hashes.
GROUPS, GROUP_BITS, SEED, HASH_CANDIDATES, LEAST_CANDIDATES = 6, 10, 5489, 10, 2
MATCHERS = ("BF", "BF_NORM_L1", "BF_HAMMING", "FLANN", "FASTCASCADEHASHINGL2")


def view_pairs(features: DataFrame) -> DataFrame:
    """All pairs i < j of the features' views; only their ids are joined. Give matchers a shorter list where there is one."""
    views = features.filter("view_id IS NOT NULL").select("view_id").distinct()
    a, b = (views.select(F.col("view_id").cast("long").alias(f"view_{n}")) for n in "ij")
    return a.join(b, F.col("view_i") < F.col("view_j"))


def blocks(features: DataFrame) -> DataFrame:
    """``view_id, block, ids, vecs``: the features of each view in blocks of about ``BLOCK`` rows, packed.

    Rows are dealt to blocks by hash, as many as the view's size asks for, so a large view becomes many
    blocks and no task holds a whole view. Vectors of floats travel as floats.
    """
    kind = "<f4" if isinstance(features.schema["vec"].dataType.elementType, T.FloatType) else "<f8"
    rows = features.filter("view_id IS NOT NULL AND feature_id IS NOT NULL AND vec IS NOT NULL").select(F.col("view_id").cast("long"), F.col("feature_id").cast("long"), F.col("vec"))
    sizes = rows.groupBy("view_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK / 2)).alias("n_blocks"))
    dealt = rows.join(sizes, "view_id").withColumn("block", F.pmod(F.xxhash64("feature_id"), F.col("n_blocks"))).drop("n_blocks")

    def pack(table: pa.Table) -> pa.Table:
        ids = table["feature_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        vecs = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        columns = {"view_id": table["view_id"][:1], "block": table["block"][:1], "ids": pa.array([ids[order].astype("<i8").tobytes()]), "vecs": pa.array([vecs.astype(kind).tobytes()])}
        return pa.table({**columns, "double": pa.array([kind == "<f8"])})

    return dealt.groupBy("view_id", "block").applyInArrow(pack, "view_id long, block long, ids binary, vecs binary, double boolean")


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
    if metric == "l1":
        return np.concatenate([np.abs(a[s : s + 16, None] - b[None]).sum(2) for s in range(0, len(a), 16)])
    if metric == "hamming":
        return (a > 0).astype(np.float64) @ (b <= 0).T + (a <= 0).astype(np.float64) @ (b > 0).T
    raise ValueError(f"unknown metric {metric}")


def nearest(features: DataFrame, metric: str = "l2", k: int = 2, backward: bool = False, pairs: DataFrame | None = None, dealt: DataFrame | None = None) -> DataFrame:
    """``view_i, view_j, query, target, distance, rank``: the ``k`` nearest features of the other view.

    Queries are of view i, or of view j if ``backward``. The blocks (``dealt``, if they are there already) of
    the two views of each pair meet, each meeting keeps its ``k`` best for each query, and the best of those are
    kept; equal distances go to the smaller id. Joins are on view and block, so work and shuffle follow the list
    of pairs.
    """
    dealt = Staging(features.sparkSession, "blocks").write(blocks(features)) if dealt is None else dealt
    wanted = (view_pairs(features) if pairs is None else pairs.select(F.least("view_i", "view_j").cast("long").alias("view_i"), F.greatest("view_i", "view_j").cast("long").alias("view_j"))).filter("view_i < view_j").distinct()
    keys = dealt.select("view_id", "block")
    for n in "ij":
        wanted = wanted.join(keys.select(F.col("view_id").alias(f"view_{n}"), F.col("block").alias(f"block_{n}")), f"view_{n}")
    for n in "ij":
        held = dealt.select(F.col("view_id").alias(f"view_{n}"), F.col("block").alias(f"block_{n}"), F.col("ids").alias(f"ids_{n}"), F.col("vecs").alias(f"vecs_{n}"), *([F.col("double")] if n == "i" else []))
        wanted = wanted.join(held, [f"view_{n}", f"block_{n}"])
    schema = pa.schema([(n, pa.int64()) for n in ("view_i", "view_j", "query", "target")] + [("distance", pa.float64())])

    def side(row: dict, n: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(row[f"ids_{n}"], "<i8")
        return ids, np.frombuffer(row[f"vecs_{n}"], "<f8" if row["double"] else "<f4").astype(np.float64).reshape(len(ids), -1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (query_ids, queries), (target_ids, targets) = [side(row, n) for n in ("ji" if backward else "ij")]
                d = np.round(_distances(queries, targets, metric), 12)
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                n = best.shape[1]
                columns = [np.full(len(query_ids) * n, row["view_i"]), np.full(len(query_ids) * n, row["view_j"]), np.repeat(query_ids, n), target_ids[best].ravel(), np.take_along_axis(d, best, 1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = wanted.select("view_i", "view_j", "ids_i", "vecs_i", "ids_j", "vecs_j", "double").mapInArrow(compare, "view_i long, view_j long, query long, target long, distance double")
    order = Window.partitionBy("view_i", "view_j", "query").orderBy("distance", "target")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ratio_matches(near: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Best matches that are nearer than ``ratio`` times the second best (strictly); one neighbour is not enough."""
    rows = near.groupBy("view_i", "view_j", "query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("target"))).alias("target"), F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("distance"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"),
    )
    return rows.filter(F.col("distance") < ratio * F.col("second"))


def mutual_matches(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Forward matches whose target has the query as its own match."""
    back = backward.select("view_i", "view_j", F.col("query").alias("target"), F.col("target").alias("query"))
    return forward.join(back, ["view_i", "view_j", "query", "target"], "left_semi")


def best_matches(matches: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest matches of each view pair."""
    order = Window.partitionBy("view_i", "view_j").orderBy("distance", "query", "target")
    return matches.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


def zero_mean(features: DataFrame) -> DataFrame:
    """``pos, mean``: the mean of each dimension."""
    return features.select(F.posexplode("vec").alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def rooted(features: DataFrame) -> DataFrame:
    return features.withColumn("vec", root_normalise(F.col("vec")))


def cascade_hash_matches(features: DataFrame, ratio: float | None = RATIO, groups: int = GROUPS, bits: int = GROUP_BITS, pairs: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """Approximate best matches: ``view_i, view_j, query, target, distance, second``; of view j's features if ``backward``.

    Vectors less their mean get a sign code as long as themselves and, in each of ``groups`` tables, a
    bucket of ``bits`` signs. Features that share a bucket are candidates; a query with no more than two
    distinct ones is left out; the ten nearest by Hamming distance of the codes are ranked by L2 distance.
    ``ratio`` None keeps the best of all, else the ratio test applies. The join is on pair, table and bucket, so
    a bucket that is full in every view is met once for each pair only.
    """
    spark = features.sparkSession
    means = [r["mean"] for r in zero_mean(features).orderBy("pos").collect()]  # one number for each dimension
    if not means:
        return spark.createDataFrame([], "view_i long, view_j long, query long, target long, distance double, second double")
    mean, dim = np.array(means), len(means)
    random = np.random.RandomState(SEED)
    code_plane, bucket_plane = random.standard_normal((dim, dim)), random.standard_normal((dim, groups * bits))
    shared = spark.sparkContext.broadcast((mean, code_plane, bucket_plane))
    schema = pa.schema([("view_id", pa.int64()), ("feature_id", pa.int64()), ("code", pa.list_(pa.int64())), ("buckets", pa.list_(pa.int32()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, codes, planes = shared.value
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            signs = np.packbits((x - centre) @ codes > 0, axis=1)
            words = np.zeros((len(x), -(-signs.shape[1] // 8) * 8), np.uint8)
            words[:, : signs.shape[1]] = signs
            bucket = ((x - centre) @ planes > 0).reshape(len(x), groups, bits) @ (1 << np.arange(bits))
            bucket = bucket + (np.arange(groups) << bits)
            columns = [batch.column(0), batch.column(1), pa.array(words.view(np.int64).tolist(), pa.list_(pa.int64())), pa.array(bucket.tolist(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = features.filter("view_id IS NOT NULL AND feature_id IS NOT NULL AND vec IS NOT NULL").select(F.col("view_id").cast("long"), F.col("feature_id").cast("long"), F.col("vec").cast("array<double>"))
    marked = Staging(spark, "codes").write(rows.mapInArrow(hashed, "view_id long, feature_id long, code array<long>, buckets array<int>"))
    keyed = marked.select("view_id", "feature_id", "code", F.explode("buckets").alias("bucket"))
    wanted = (view_pairs(features) if pairs is None else pairs.select(F.least("view_i", "view_j").alias("view_i"), F.greatest("view_i", "view_j").alias("view_j"))).filter("view_i < view_j").distinct()
    q, t = ("view_j", "view_i") if backward else ("view_i", "view_j")
    a = keyed.select(F.col("view_id").alias(q), F.col("feature_id").alias("query"), F.col("code").alias("code_i"), "bucket")
    b = keyed.select(F.col("view_id").alias(t), F.col("feature_id").alias("target"), F.col("code").alias("code_j"), "bucket")
    apart = F.aggregate(F.zip_with("code_i", "code_j", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    met = a.join(wanted, q).join(b, [t, "bucket"]).select("view_i", "view_j", "query", "target", apart.alias("hamming")).distinct()
    each = Window.partitionBy("view_i", "view_j", "query")
    ranked = met.withColumn("n", F.row_number().over(each.orderBy("hamming", "target"))).filter(F.col("n") <= HASH_CANDIDATES)
    few = ranked.withColumn("most", F.max("n").over(each)).filter(F.col("most") > LEAST_CANDIDATES).select("view_i", "view_j", "query", "target")

    def side(view: str, feature: str, vec: str) -> DataFrame:
        return rows.select(F.col("view_id").alias(view), F.col("feature_id").alias(feature), F.col("vec").alias(vec))

    near = few.join(side(q, "query", "va"), [q, "query"]).join(side(t, "target", "vb"), [t, "target"])
    d = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = near.select("view_i", "view_j", "query", "target", d.alias("distance"))
    near = near.withColumn("rank", F.row_number().over(each.orderBy("distance", "target"))).filter("rank <= 2")
    return ratio_matches(near, ratio if ratio is not None else float("inf"))


def pair_seed(i: Column, j: Column) -> Column:
    """Deterministic seed of a view pair."""
    return F.lit(12345).cast("long").bitwiseXOR((F.lit(7919) * i + F.lit(7927) * j).cast("long"))


def match_views(features: DataFrame, matcher: str = "BF", ratio: float | None = RATIO, cross_check: bool = False, most: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Matches of view pairs (all, or those of a list) by a named matcher; ratio test, cross check and limit apply one
    after another. ``FLANN`` is the exact matcher, as its approximate trees are no part of this library."""
    name = matcher.upper()
    if name not in MATCHERS:
        raise ValueError(f"matchers are {MATCHERS}")
    metric = {"BF_NORM_L1": "l1", "BF_HAMMING": "hamming"}.get(name, "l2")
    dealt = None if name == "FASTCASCADEHASHINGL2" else Staging(features.sparkSession, "blocks").write(blocks(features))

    def one_way(backward: bool) -> DataFrame:
        if name == "FASTCASCADEHASHINGL2":
            return cascade_hash_matches(features, ratio, pairs=pairs, backward=backward)
        found = nearest(features, metric, 2, backward, pairs, dealt)
        return ratio_matches(found, ratio) if ratio is not None else found.filter("rank = 1")

    out = one_way(False)
    if cross_check:
        out = mutual_matches(out, one_way(True))
    return best_matches(out, most) if most is not None else out
