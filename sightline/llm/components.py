"""Groups of records linked directly or through others, by seed-tree pruning.

In each round every vertex links itself and its neighbours to the smallest vertex of its
neighbourhood. A vertex that is nobody's smallest drops out: it keeps one tree edge to the smallest
vertex it was given, its other links pass to that vertex, and the graph shrinks to the seeds. When no
edge is left, the seeds' identifiers flow down the forest of tree edges, last round first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.runtime import Staging


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``id, group_id`` for each vertex with an edge to another; group_id is the group's smallest id.

    ``edges`` is read as undirected, in columns ``a`` and ``b`` of integers; nulls, loops and repeats
    link nothing more, other columns are ignored, no edges give no rows. Every round is one min per
    vertex, combined on the map side, and joins on the vertex, which AQE splits where a hub holds many
    edges; no neighbourhood is ever collected. Rounds are written to the shared folder, so a lost
    executor costs one stage, and superseded rounds are deleted.
    """
    spark = edges.sparkSession
    staging = Staging(spark, "components")
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    graph = staging.write(edges.filter(x != y).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct())
    forest: list[DataFrame] = []
    for _ in range(max_rounds):
        if graph.isEmpty():
            break
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("u", "mv").alias("m"))
        given = both.join(smallest, "u").select(F.col("v").alias("x"), "m").unionByName(smallest.select(F.col("u").alias("x"), "m"))
        given = staging.write(given)
        roots = given.groupBy("x").agg(F.min("m").alias("root"), F.max(F.col("m") == F.col("x")).alias("seed"))
        following = staging.write(
            given.join(roots, "x").filter("m <> root").select(F.col("root").alias("u"), F.col("m").alias("v")).distinct()
        )
        forest.append(staging.write(roots.filter(~F.col("seed")).select(F.col("x").alias("id"), F.col("root").alias("parent"))))
        staging.drop(given)
        staging.drop(graph)
        graph = following
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    labels: DataFrame | None = None
    for tree in reversed(forest):
        if labels is None:
            level = tree.select("id", F.col("parent").alias("group_id"))
        else:
            above = labels.select(F.col("id").alias("parent"), "group_id")
            level = staging.write(tree.join(above, "parent", "left").select("id", F.coalesce("group_id", "parent").alias("group_id")))
            staging.drop(tree)
        labels = level if labels is None else labels.unionByName(level)
    if labels is None:
        return graph.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    return labels.unionByName(labels.select(F.col("group_id").alias("id"), "group_id").distinct())


def keypoint_links(keypoints: DataFrame, matches: DataFrame, points: DataFrame) -> DataFrame:
    """Links ``a, b`` between keypoint ids: inlier matches, and each track's keypoints with its smallest.

    Keypoints are named by (image_id, kp_idx). Matches whose is_inlier is not true, points whose is_used
    is not true, and ends or elements that are null or name no keypoint link nothing. A track is one row's
    (the same point twice with different tracks are two). Its minimum is combined on the map side and
    joined back, so a long track is never gathered.
    """
    staging = Staging(keypoints.sparkSession, "links")
    place = keypoints.filter("kp_id IS NOT NULL").groupBy("image_id", "kp_idx").agg(F.min("kp_id").alias("kp"))

    def at(image: str, idx: str, out: str) -> DataFrame:
        return place.select(F.col("image_id").alias(image), F.col("kp_idx").cast("long").alias(idx), F.col("kp").alias(out))

    ends = matches.filter("is_inlier").select("view_i", "feat_i", "view_j", "feat_j")
    pairs = ends.join(at("view_i", "feat_i", "a"), ["view_i", "feat_i"]).join(at("view_j", "feat_j", "b"), ["view_j", "feat_j"]).select("a", "b")

    elements = points.filter("is_used").select("point_id", F.xxhash64("track").alias("version"), F.explode("track").alias("e"))
    elements = elements.select("point_id", "version", F.col("e.image_id").alias("image_id"), F.col("e.point2d_idx").cast("long").alias("kp_idx"))
    members = staging.write(elements.join(at("image_id", "kp_idx", "b"), ["image_id", "kp_idx"]).select("point_id", "version", "b"))
    least = members.groupBy("point_id", "version").agg(F.min("b").alias("a"))
    stars = members.join(least, ["point_id", "version"]).select("a", "b")
    return pairs.unionByName(stars).filter("a <> b")
