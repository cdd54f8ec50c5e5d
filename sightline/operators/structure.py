"""Relations of the reconstruction model: features, matches, tracks, poses; their joins, filters and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators.versions import current_rows
from sightline.runtime import Staging

PAIR = ("view_i", "view_j")
# A pair needs so many matches, so many inliers and such a share of them.
MIN_MATCHES, MIN_INLIERS, MIN_RATIO, SOLVER_INLIERS = 50, 50, 0.25, 6


def features(keypoints: DataFrame) -> DataFrame:
    """One row for each (view, feature): its latest row, as ``view_id, feature_id, kp_id, x, y, size, angle``.

    A NaN is no place, size or angle, and becomes null.
    """

    def number(c: str) -> Column:
        return F.nullif(F.col(f"r.{c}").cast("double"), F.lit(float("nan")))

    latest = F.max(F.struct("added_at", "kp_id", "x", "y", "scale", "orientation")).alias("r")
    rows = keypoints.filter("image_id IS NOT NULL AND kp_idx IS NOT NULL").groupBy("image_id", "kp_idx").agg(latest)
    return rows.select(
        F.col("image_id").alias("view_id"), F.col("kp_idx").cast("long").alias("feature_id"), F.col("r.kp_id").alias("kp_id"),
        number("x").alias("x"), number("y").alias("y"), number("scale").alias("size"), number("orientation").alias("angle"),
    )


def rescale(features: DataFrame, factor: float) -> DataFrame:
    """Place and size of features of a resized image, such as 0.5 or 2 for an octave."""
    return features.select(*[(F.col(c) * factor).alias(c) if c in ("x", "y", "size") else F.col(c) for c in features.columns])


def poses(images: DataFrame) -> DataFrame:
    """``view_id, name, camera_id, q, r, t`` of current rows whose pose is complete and finite; t of x = R X + t."""
    rows = current_rows(images, "image_id", "added_at", ["name", "camera_id", "qvec", "tvec"])

    def finite(v: Column, n: int) -> Column:
        return (F.size(v) == n) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))

    good = F.coalesce(finite(F.col("qvec"), 4) & finite(F.col("tvec"), 3), F.lit(False))
    kept = rows.filter(good).select(F.col("image_id").alias("view_id"), "name", "camera_id", g.normalise_quaternion(F.when(good, F.col("qvec"))).alias("q"), F.when(good, F.col("tvec")).alias("t"))
    return kept.filter("q IS NOT NULL").withColumn("r", g.quaternion_to_rotation(F.col("q"), normalise=False))


def intrinsics(cameras: DataFrame) -> DataFrame:
    """``camera_id, fx, fy, cx, cy, width, height`` of each camera's latest row; missing parts are null.

    Two parameters or fewer are unusable, four or more are read as (f, cx, cy, ...) if the model is radial
    (2 or 3), else as (fx, fy, cx, cy, ...).
    """
    rows = current_rows(cameras, "camera_id", "added_at", ["model", "width", "height", "params"])
    p = F.col("params")
    enough = F.size(p) >= 4
    single = F.col("model").isin(2, 3, 4) & (F.size(p) != 4)
    return rows.select(
        "camera_id", "width", "height", F.when(enough, p[0]).alias("fx"), F.when(enough, F.when(single, p[0]).otherwise(p[1])).alias("fy"),
        F.when(enough, F.when(single, p[1]).otherwise(p[2])).alias("cx"), F.when(enough, F.when(single, p[2]).otherwise(p[3])).alias("cy"),
    )


def join_coordinates(matches: DataFrame, features: DataFrame) -> DataFrame:
    """Matches with the places of both features; a match of a feature that does not exist is dropped."""
    left = features.select(F.col("view_id").alias("view_i"), F.col("feature_id").alias("feat_i"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    right = features.select(F.col("view_id").alias("view_j"), F.col("feature_id").alias("feat_j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return matches.join(left, ["view_i", "feat_i"]).join(right, ["view_j", "feat_j"])


def join_metadata(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs with name and camera of both images; pairs of an unknown image are dropped."""
    a = images.select(F.col("image_id").alias("view_i"), F.col("name").alias("name_i"), F.col("camera_id").alias("camera_i"))
    b = images.select(F.col("image_id").alias("view_j"), F.col("name").alias("name_j"), F.col("camera_id").alias("camera_j"))
    return pairs.join(a, "view_i").join(b, "view_j")


def bearing_pairs(located: DataFrame, images: DataFrame, cameras: DataFrame, inliers_only: bool = False) -> DataFrame:
    """``view_i, view_j, match_idx, b1, b2``: viewing directions of both ends of located matches."""
    if inliers_only:
        located = located.filter("is_inlier")
    k = images.select("image_id", "camera_id").join(cameras, "camera_id")

    def side(n: str, v: str) -> DataFrame:
        return k.select(F.col("image_id").alias(v), *[F.col(c).alias(f"{c}{n}") for c in ("fx", "fy", "cx", "cy")])

    rows = located.join(side("1", "view_i"), "view_i").join(side("2", "view_j"), "view_j")
    b = [g.bearing(F.col(f"x{n}"), F.col(f"y{n}"), *[F.col(f"{c}{n}") for c in ("fx", "fy", "cx", "cy")]).alias(f"b{n}") for n in "12"]
    return rows.select(*PAIR, "match_idx", *b).filter("b1 IS NOT NULL AND b2 IS NOT NULL")


def point_lists(located: DataFrame) -> DataFrame:
    """For each pair the places of its matches on either side, in the order of match_idx."""
    ordered = F.array_sort(F.collect_list(F.struct("match_idx", "x1", "y1", "x2", "y2")))
    rows = located.groupBy(*PAIR).agg(ordered.alias("m"))
    return rows.select(*PAIR, F.transform("m", lambda p: F.array(p["x1"], p["y1"])).alias("points_i"), F.transform("m", lambda p: F.array(p["x2"], p["y2"])).alias("points_j"))


def lookup_names(files: DataFrame, name: str, known: DataFrame, known_name: str, known_id: str) -> tuple[DataFrame, DataFrame]:
    """Files with the id of their name, and the files whose name is not known."""
    ids = known.select(F.col(known_name).alias(name), F.col(known_id).alias("view_id"))
    return files.join(ids, name), files.join(ids, name, "left_anti")


def view_pairs(views: DataFrame, id_col: str, scene: str) -> DataFrame:
    """All pairs i < j of the views of each scene; views of no scene have none. Their number is its nature: the
    join is on the scene, and AQE splits the side of a large one."""
    a, b = (views.filter(F.col(scene).isNotNull()).select(F.col(scene).alias("_s"), F.col(id_col).alias(f"view_{n}")).distinct() for n in "ij")
    return a.join(b, "_s").filter("view_i < view_j").drop("_s")


def with_shared_camera(views: DataFrame, camera: DataFrame) -> DataFrame:
    """Every view with the one camera they share; ``camera`` must have a single row."""
    return views.crossJoin(F.broadcast(camera.limit(1)))


def keep_matched_pairs(matches: DataFrame, least: int = MIN_MATCHES) -> DataFrame:
    """Inlier flags are cleared, and ``kept`` false, for pairs with fewer than ``least`` matches.

    Counted per pair on the map side and joined back, so one pair may hold any share of all matches.
    """
    sizes = matches.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_matches"))
    rows = matches.join(sizes, list(PAIR))
    kept = F.col("n_matches") >= least
    return rows.withColumn("kept", kept).withColumn("is_inlier", F.coalesce("is_inlier", F.lit(False)) & kept)


def pair_problems(pairs: DataFrame, views: DataFrame) -> DataFrame:
    """How many pairs have which problem: no inliers, or a view that does not exist."""
    known = views.select(F.col("view_id")).distinct()
    a, b = known.select(F.col("view_id").alias("view_i"), F.lit(True).alias("has_i")), known.select(F.col("view_id").alias("view_j"), F.lit(True).alias("has_j"))
    rows = pairs.join(a, "view_i", "left").join(b, "view_j", "left")
    reason = F.when(F.col("has_i").isNull() | F.col("has_j").isNull(), "out_of_range").when(F.col("n_inliers") == 0, "empty").otherwise("ok")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_pairs"))


def pair_quality(matches: DataFrame, least: int = MIN_INLIERS, ratio: float = MIN_RATIO, solver: int = SOLVER_INLIERS) -> DataFrame:
    """Matches and inliers of each pair and whether they suffice."""
    rows = matches.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_matches"), F.count_if("is_inlier").alias("n_inliers"))
    enough = (F.col("n_inliers") >= least) & (F.col("n_inliers") / F.col("n_matches") >= ratio) & (F.col("n_inliers") >= solver)
    return rows.withColumn("passed", enough)


def sync_inliers(matches: DataFrame, found: DataFrame) -> DataFrame:
    """Flags found for the n-th inlier of each pair, set at the match they belong to; the rest are no inliers.

    ``found``: view_i, view_j, ``nth`` from 0, ``ok``.
    """
    order = Window.partitionBy(*PAIR).orderBy("match_idx")
    numbered = matches.filter("is_inlier").withColumn("nth", (F.row_number().over(order) - 1).cast("long"))
    flags = numbered.join(found.select(*PAIR, F.col("nth").cast("long").alias("nth"), "ok"), [*PAIR, "nth"], "left").select(*PAIR, "match_idx", F.coalesce("ok", F.lit(False)).alias("ok"))
    return matches.join(flags, [*PAIR, "match_idx"], "left").withColumn("is_inlier", F.coalesce("ok", F.lit(False))).drop("ok")


def observations(points: DataFrame) -> DataFrame:
    """``track_id, obs_idx, view_id, feature_id, is_used`` of the complete elements of every track; repeats once."""
    rows = points.select("point_id", "is_used", "track").distinct().select("point_id", "is_used", F.posexplode("track").alias("obs_idx", "e"))
    return rows.select(
        F.col("point_id").alias("track_id"), "obs_idx", F.col("e.image_id").alias("view_id"), F.col("e.point2d_idx").cast("long").alias("feature_id"), F.coalesce("is_used", F.lit(False)).alias("is_used")
    ).filter("view_id IS NOT NULL AND feature_id IS NOT NULL")


def image_points(obs: DataFrame) -> DataFrame:
    """For each view how many tracks it sees, and its used observations."""
    return obs.groupBy("view_id").agg(F.count(F.lit(1)).alias("n_observations"), F.count_if("is_used").alias("n_used"), F.min("track_id").alias("first_track"), F.max("track_id").alias("last_track"))


def valid_views(obs: DataFrame) -> DataFrame:
    """``view_id, est_id``: views seen in used tracks, numbered densely from 0 in order of their ids.

    The ids are numbered by range partitions and their sizes, not in one window over all views. The parts are
    staged, so that both uses of them see the same ones, whatever is planned or computed again.
    """
    views = obs.filter("is_used").select("view_id").distinct()
    numbered = Staging(obs.sparkSession, "numbers").write(views.sort("view_id").withColumn("part", F.spark_partition_id()))
    within = numbered.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("view_id")))
    sizes = within.groupBy("part").agg(F.max("n").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size")).select("part", "before")
    return within.join(before, "part").select("view_id", (F.col("n") - 1 + F.col("before")).alias("est_id"))


def coordinate_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Half the sum of squared displacements, and their mean, over observations used in both and of one view."""
    a = before.select("track_id", "obs_idx", *[F.col(c).alias(f"{c}_a") for c in ("view_id", "x", "y", "is_used")])
    b = after.select("track_id", "obs_idx", *[F.col(c).alias(f"{c}_b") for c in ("view_id", "x", "y", "is_used")])
    rows = a.join(b, ["track_id", "obs_idx"]).filter("is_used_a AND is_used_b AND view_id_a = view_id_b")
    square = (F.col("x_b") - F.col("x_a")) * (F.col("x_b") - F.col("x_a")) + (F.col("y_b") - F.col("y_a")) * (F.col("y_b") - F.col("y_a"))
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.sum(square) / 2).alias("half_sum"), F.avg(square).alias("mean"))


def track_means(obs: DataFrame, values: list[str]) -> DataFrame:
    """Means of values over the used observations of each track, null where none is used."""
    used = F.col("is_used")
    return obs.groupBy("track_id").agg(F.count_if(used).alias("n_used"), *[F.avg(F.when(used, F.col(v))).alias(f"mean_{v}") for v in values])


def scene_scale(centres: DataFrame, scene: str, x: str, y: str, z: str, id_col: str) -> DataFrame:
    """Of each scene the greatest distance of two centres, the least of those above a hundredth of it, and one over that.

    The scale is kept between 1e-6 and 1e6; a scene without two different centres has no row. Pairs of the
    centres of a scene are its nature; they are joined on the scene and combined on the map side.
    """
    named = centres.filter(F.col(scene).isNotNull())
    a, b = (named.select(F.col(scene).alias("scene"), F.col(id_col).alias(f"id{n}"), *[F.col(c).alias(f"{k}{n}") for c, k in ((x, "x"), (y, "y"), (z, "z"))]) for n in "12")
    d = F.sqrt(sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0)))
    distances = a.join(b, "scene").filter("id1 < id2").select("scene", d.alias("d"))
    most = distances.groupBy("scene").agg(F.max("d").alias("greatest"))
    out = distances.join(most, "scene").filter("d >= 0.01 * greatest AND d > 0").groupBy("scene").agg(F.max("greatest").alias("greatest"), F.min("d").alias("least"))
    return out.withColumn("scale", F.least(F.greatest(1 / F.col("least"), F.lit(1e-6)), F.lit(1e6)))


def _long(df: DataFrame, data: str) -> DataFrame:
    pairs = [x for c in df.columns for x in (F.lit(c), F.col(c).cast("double"))]
    return df.select(F.lit(data).alias("data"), F.explode(F.create_map(*pairs)).alias("metric", "value"))


def feature_statistics(features: DataFrame) -> DataFrame:
    per = features.groupBy("view_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_features"), F.count(F.lit(1)).alias("n_images"), F.avg("n").alias("mean_features"))


def match_statistics(matches: DataFrame) -> DataFrame:
    per = matches.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_inlier").alias("ok"))
    return per.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"), F.avg("n").alias("mean_matches"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("n_inliers"), F.count_if(F.col("ok") > 0).alias("n_pairs_with_inliers"),
    )


def inlier_split(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_inlier").alias("inliers"), F.count_if(~F.coalesce("is_inlier", F.lit(False))).alias("outliers"))


def track_statistics(obs: DataFrame) -> DataFrame:
    per = obs.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_used").alias("used"))
    out = per.agg(
        F.count(F.lit(1)).alias("n_tracks"), F.count_if(F.col("n") >= 2).alias("n_multi_view"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_observations"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_used")
    )
    return out.withColumn("used_ratio", F.col("n_used") / F.nullif(F.col("n_observations"), F.lit(0)))


def point_statistics(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("n_points"), F.count_if("is_used").alias("n_used"))


def relative_pose_statistics(rel: DataFrame) -> DataFrame:
    """Pairs, valid ones (neither an identity rotation nor a zero translation), the views they imply and their coverage."""
    identity = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])
    valid = (g.frobenius(F.col("r"), identity) > 1e-9) & (g.norm(F.col("t")) > 1e-12)
    out = rel.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(valid).alias("n_valid"))
    n = F.floor(F.sqrt(2.0 * F.col("n_pairs")) + 1).cast("long")
    return out.withColumn("n_views", n).withColumn("coverage", F.col("n_pairs") / F.nullif(F.col("n_views") * (F.col("n_views") - 1) / 2, F.lit(0.0)))


def global_pose_statistics(poses: DataFrame) -> DataFrame:
    """Poses and valid ones (a rotation or a translation that is not zero)."""
    zero = F.array(*[F.lit(0.0)] * 9)
    valid = (g.frobenius(F.col("r"), zero) > 1e-12) | (g.norm(F.col("t")) > 1e-12)
    return poses.agg(F.count(F.lit(1)).alias("n_poses"), F.count_if(valid).alias("n_valid"))


def package_statistics(parts: dict[str, DataFrame]) -> DataFrame:
    """The statistics of several data in long form: ``data, metric, value``."""
    return reduce(DataFrame.unionByName, [_long(df, name) for name, df in parts.items()])


def pose_errors(estimated: DataFrame, truth: DataFrame) -> DataFrame:
    """Rotation and direction error in degrees and distance of the centres, of views that have both poses."""
    e = estimated.select("view_id", F.col("r").alias("re"), F.col("t").alias("te"))
    t = truth.select("view_id", F.col("r").alias("rt"), F.col("t").alias("tt"))
    rows = e.join(t, "view_id")
    return rows.select(
        "view_id", g.rotation_angle(F.col("re"), F.col("rt")).alias("rotation_error"), g.direction_angle(F.col("te"), F.col("tt")).alias("direction_error"),
        g.distance(g.camera_centre(F.col("re"), F.col("te")), g.camera_centre(F.col("rt"), F.col("tt"))).alias("position_error"),
    )


def relative_poses(pairs: DataFrame, poses: DataFrame) -> DataFrame:
    """``view_i, view_j, r, t`` of the pairs whose views both have a pose (x = R X + t)."""
    a = poses.select(F.col("view_id").alias("view_i"), F.col("r").alias("ri"), F.col("t").alias("ti"))
    b = poses.select(F.col("view_id").alias("view_j"), F.col("r").alias("rj"), F.col("t").alias("tj"))
    rows = pairs.select(*PAIR).join(a, "view_i").join(b, "view_j")
    rij = g.multiply(F.col("rj"), g.transpose(F.col("ri")))
    return rows.withColumn("r", rij).select(*PAIR, "r", g.subtract(F.col("tj"), g.apply(F.col("r"), F.col("ti"))).alias("t"))


def relative_pose_errors(estimated: DataFrame, truth: DataFrame, either_order: bool = False) -> DataFrame:
    """Errors of relative poses of the same ordered pair; ``either_order`` also compares a swapped pair, inverted."""
    if either_order:
        ri, ti = g.invert_pose(F.col("r"), F.col("t"))
        swapped = truth.select(F.col("view_j").alias("view_i"), F.col("view_i").alias("view_j"), ri.alias("r"), ti.alias("t"))
        truth = truth.select(*PAIR, "r", "t").unionByName(swapped.join(truth.select(*PAIR), list(PAIR), "left_anti"))
    e = estimated.select(*PAIR, F.col("r").alias("re"), F.col("t").alias("te"))
    rows = e.join(truth.select(*PAIR, F.col("r").alias("rt"), F.col("t").alias("tt")), list(PAIR))
    return rows.select(*PAIR, g.rotation_angle(F.col("re"), F.col("rt")).alias("rotation_error"), g.direction_angle(F.col("te"), F.col("tt")).alias("direction_error"))


def best_candidate(errors: DataFrame, keys: list[str], candidate: str, error: str) -> DataFrame:
    """Of each key the candidate with the least error, the smaller one of equals."""
    return errors.groupBy(*keys).agg(F.min_by(F.struct(F.col(candidate).alias("c"), F.col(error).alias("e")), F.struct(error, candidate)).alias("b")).select(*keys, F.col("b.c").alias(candidate), F.col("b.e").alias(error))


def normalise_centres(centres: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Centres moved to the mean of their group and divided by the root mean square distance from it."""
    mean = centres.groupBy(*keys).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    moved = centres.join(mean, keys).select(*[c for c in centres.columns if c not in columns], *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in columns])
    spread = moved.groupBy(*keys).agg(F.sqrt(F.avg(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))).alias("_s"))
    return moved.join(spread, keys).select(*[c for c in centres.columns if c not in columns], *[(F.col(c) / F.nullif(F.col("_s"), F.lit(0.0))).alias(c) for c in columns])


def planar_grid(columns: int, rows: int, size: float, centred: bool, spark) -> DataFrame:
    """Points of a board: ``idx, x, y, z``."""
    grid = spark.range(rows).select(F.col("id").alias("r")).select("r", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"))
    dx, dy = ((columns - 1) / 2, (rows - 1) / 2) if centred else (0, 0)
    return grid.select((F.col("r") * columns + F.col("c")).alias("idx"), ((F.col("c") - dx) * size).alias("x"), ((F.col("r") - dy) * size).alias("y"), F.lit(0.0).alias("z"))
