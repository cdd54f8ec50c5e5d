"""View graphs: edges, components, spanning forests, rotations along them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.runtime import Staging

FINISH_LINKS = 1_000_000  # so many links, 16 bytes each, go into one task


def view_graph(pairs: DataFrame, rotation: str | None = None) -> DataFrame:
    """Both directions of each edge: ``src, dst, weight`` and, if given, the rotation and its transpose."""
    extra = [F.col(rotation).alias("r")] if rotation else []
    back = [g.transpose(F.col(rotation)).alias("r")] if rotation else []
    there = pairs.select(F.col("view_i").alias("src"), F.col("view_j").alias("dst"), "weight", *extra)
    return there.unionByName(pairs.select(F.col("view_j").alias("src"), F.col("view_i").alias("dst"), "weight", *back))


def _finish(links: DataFrame) -> DataFrame:
    """``u, v``: each vertex ``v`` of the links with the smallest one of its component, found in one task."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        u, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        ids, at = np.unique(np.r_[u, v], return_inverse=True)
        x, y, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            apart = low < high
            x, y = x[apart], y[apart]
            np.minimum.at(root, high[apart], low[apart])
            while (root != root[root]).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(ids[root]), pa.array(ids)], names=["u", "v"])

    return links.coalesce(1).mapInArrow(label, "u long, v long").filter("u <> v")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100, finish_links: int = FINISH_LINKS) -> DataFrame:
    """``id, component``: alternating stars. Each round links every vertex's larger neighbours to its smallest, then
    its smaller ones, and stops when no link changes; the component's id is its smallest vertex. Vertices with
    loops only are components of their own; nulls link nothing. Links that are ``finish_links`` or fewer, at first
    or after a round, are finished by one task, which gives the same components."""
    staging = Staging(edges.sparkSession, "stars")
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    start = edges.filter(x.isNotNull() & y.isNotNull()).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    vertices = staging.write(start.select(F.col("u").alias("id")).unionByName(start.select(F.col("v").alias("id"))).distinct())
    links = staging.write(start.filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        if links.limit(finish_links + 1).count() <= finish_links:
            links = staging.write(_finish(links))
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v")
        large = staging.write(large.distinct())
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"))
        following = staging.write(small.filter("u <> v").distinct())
        sums = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        staging.drop(large)
        staging.drop(links)
        links = following
        if tuple(sums) == before:
            break
        before = tuple(sums)
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return vertices.join(links.select(F.col("v").alias("id"), F.col("u").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def build_tracks(matches: DataFrame, features: DataFrame, drop_conflicts: bool = False) -> DataFrame:
    """``track_id, view_id, feature_id`` of features linked by inlier matches; a track's id is its smallest keypoint.

    ``drop_conflicts`` leaves out tracks that see a view twice.
    """
    ids = features.select("view_id", "feature_id", F.col("kp_id"))
    a = ids.select(F.col("view_id").alias("view_i"), F.col("feature_id").alias("feat_i"), F.col("kp_id").alias("a"))
    b = ids.select(F.col("view_id").alias("view_j"), F.col("feature_id").alias("feat_j"), F.col("kp_id").alias("b"))
    links = matches.filter("is_inlier").join(a, ["view_i", "feat_i"]).join(b, ["view_j", "feat_j"]).filter("a <> b").select("a", "b")
    tracks = components(links).join(ids, F.col("id") == F.col("kp_id")).select(F.col("component").alias("track_id"), "view_id", "feature_id")
    if drop_conflicts:
        twice = tracks.groupBy("track_id", "view_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("track_id").distinct()
        tracks = tracks.join(twice, "track_id", "left_anti")
    return tracks


def _forest_in_memory(rows: list) -> list[tuple[int, int, float]]:
    """Kruskal's forest of (i, j, weight) rows."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j, weight in sorted(rows, key=lambda e: (-e[2], e[0], e[1])):
        if (a := root(i)) != (b := root(j)):
            parent[b] = a
            out.append((i, j, weight))
    return out


def maximum_spanning_forest(pairs: DataFrame, max_rounds: int = 64, driver_edges: int = 100_000) -> DataFrame:
    """``view_i, view_j, weight``: the spanning forest of greatest weight, by rounds of each part's best edge.

    Of equal weights the smaller (view_i, view_j) is better, so the forest is unique. Loops, null ends and
    null weights are no edges; of repeated pairs the heaviest counts. Parts at least halve each round. A
    graph of at most ``driver_edges`` edges, counted first, is done by the driver, with the same result.
    """
    staging = Staging(pairs.sparkSession, "forest")
    i, j = F.least("view_i", "view_j"), F.greatest("view_i", "view_j")
    edges = pairs.filter("view_i <> view_j AND weight IS NOT NULL").select(i.cast("long").alias("i"), j.cast("long").alias("j"), F.col("weight").cast("double").alias("weight"))
    edges = staging.write(edges.groupBy("i", "j").agg(F.max("weight").alias("weight")).withColumn("a", F.col("i")).withColumn("b", F.col("j")))
    if edges.count() <= driver_edges:
        rows = _forest_in_memory([(e["i"], e["j"], e["weight"]) for e in edges.collect()])
        return pairs.sparkSession.createDataFrame(rows, "view_i long, view_j long, weight double")
    chosen = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        ends = edges.select(F.col("a").alias("part"), "i", "j", "weight").unionByName(edges.select(F.col("b").alias("part"), "i", "j", "weight"))
        best = ends.groupBy("part").agg(F.min_by(F.struct("i", "j", "weight"), F.struct(-F.col("weight"), "i", "j")).alias("e"))
        picked = staging.write(best.select("e.i", "e.j", "e.weight").distinct())
        chosen = picked if chosen is None else chosen.unionByName(picked)
        links = edges.join(picked.select("i", "j"), ["i", "j"], "left_semi").select("a", "b")
        part = components(links, finish_links=FINISH_LINKS if driver_edges else 0).select(F.col("id"), F.col("component"))
        moved = edges.join(part.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(part.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        rest = moved.select("i", "j", "weight", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
        edges = staging.write(rest)
    if chosen is None:
        chosen = edges.select("i", "j", "weight")
    return chosen.select(F.col("i").alias("view_i"), F.col("j").alias("view_j"), "weight").distinct()


def _levels_in_memory(root: int, edges: list) -> list[tuple[int, list[float], int]]:
    """(view, rotation, depth) of all views that directed (src, dst, r) edges reach from the root."""
    import numpy as np

    around: dict[int, list] = {}
    for src, dst, r in sorted(edges, key=lambda e: (e[0], e[1])):
        around.setdefault(src, []).append((dst, np.array(r).reshape(3, 3)))
    found, level, depth = {root: (np.eye(3), 0)}, [root], 0
    while level:
        depth += 1
        following = []
        for view in level:
            for dst, r in around.get(view, ()):
                if dst not in found:
                    found[dst] = (r @ found[view][0], depth)
                    following.append(dst)
        level = sorted(following)
    return [(view, [float(x) for x in r.ravel()], d) for view, (r, d) in found.items()]


def propagate_rotations(views: DataFrame, tree: DataFrame, root: int | None = None, max_rounds: int = 10_000, driver_edges: int = 100_000) -> DataFrame:
    """``view_id, r, depth`` along a tree of relative rotations ``view_i, view_j, r`` (R_j = R R_i).

    The root, by default the smallest view, has the identity. Views that are not reached have a null
    rotation and depth. A tree of at most ``driver_edges`` edges, counted first, is walked by the driver; a
    larger one takes one join per level, each level being written, and never goes back to where it came from.
    """
    staging = Staging(views.sparkSession, "levels")
    edges = staging.write(view_graph(tree.withColumn("weight", F.lit(1.0)), "r").select("src", "dst", "r"))
    if root is None:
        root = views.agg(F.min("view_id")).first()[0]
    if root is None:
        return views.select("view_id", F.lit(None).cast("array<double>").alias("r"), F.lit(None).cast("int").alias("depth"))
    if edges.count() <= 2 * driver_edges:
        rows = _levels_in_memory(root, [tuple(e) for e in edges.collect()])
        reached = views.sparkSession.createDataFrame(rows, "view_id long, r array<double>, depth int")
        return views.select("view_id").distinct().join(reached, "view_id", "left")
    identity = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])
    start = views.filter(F.col("view_id") == F.lit(root)).select(F.col("view_id").cast("long").alias("view_id"), identity.alias("r"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("above"))
    level = staging.write(start.distinct())
    reached = level
    for depth in range(1, max_rounds):
        step = level.select(F.col("view_id").alias("src"), F.col("r").alias("rs"), "above").join(edges, "src").filter(~F.col("dst").eqNullSafe(F.col("above")))
        level = staging.write(step.select(F.col("dst").alias("view_id"), g.multiply(F.col("r"), F.col("rs")).alias("r"), F.lit(depth).alias("depth"), F.col("src").alias("above")))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return views.select("view_id").distinct().join(reached.select("view_id", "r", "depth"), "view_id", "left")


def views_in_state(views: DataFrame, state: str) -> DataFrame:
    return views.filter(F.col("state") == state)


def count_states(views: DataFrame) -> DataFrame:
    return views.groupBy("state").agg(F.count(F.lit(1)).alias("n_views"))
