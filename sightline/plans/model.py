"""Queries of the reconstruction tables: joins, filters, statistics, selections, poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions.parsing import base_name, dataset_name, pair_id, split_pair_id, strip_extension
from sightline.operators import robust, selection
from sightline.operators import structure as st
from sightline.operators.versions import current_rows
from sightline.runtime import table

DIGITS = 6


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "matches").distinct()


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "images"), "image_id", "added_at", ["name", "camera_id"])


def _array(c, n, digits=DIGITS):
    """Rounded elements as columns c0, c1, ...; zero has no sign."""
    return [(F.round(F.col(c)[i], digits) + F.lit(0.0)).alias(f"{c}{i}") for i in range(n)]


def stats_features(spark, sf_dir):
    return st.feature_statistics(st.features(table(spark, sf_dir, "keypoints"))).withColumn("mean_features", F.round("mean_features", 6))


def stats_matches(spark, sf_dir):
    return st.match_statistics(_matches(spark, sf_dir)).withColumn("mean_matches", F.round("mean_matches", 6))


def match_inlier_split(spark, sf_dir):
    return st.inlier_split(_matches(spark, sf_dir))


def stats_tracks(spark, sf_dir):
    return st.track_statistics(st.observations(table(spark, sf_dir, "points3d"))).withColumn("used_ratio", F.round("used_ratio", 6))


def stats_points(spark, sf_dir):
    return st.point_statistics(table(spark, sf_dir, "points3d").distinct())


def _relative(spark, sf_dir):
    return st.relative_poses(_matches(spark, sf_dir).select("view_i", "view_j").distinct(), st.poses(table(spark, sf_dir, "images")))


def stats_relposes(spark, sf_dir):
    return st.relative_pose_statistics(_relative(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


def stats_global_poses(spark, sf_dir):
    return st.global_pose_statistics(st.poses(table(spark, sf_dir, "images")))


def stats_package(spark, sf_dir):
    parts = {
        "data_features": st.feature_statistics(st.features(table(spark, sf_dir, "keypoints"))), "data_matches": st.match_statistics(_matches(spark, sf_dir)),
        "data_tracks": st.track_statistics(st.observations(table(spark, sf_dir, "points3d"))), "data_points_3d": st.point_statistics(table(spark, sf_dir, "points3d").distinct()),
    }
    return st.package_statistics(parts).withColumn("value", F.round("value", 6))


def match_join_coordinates(spark, sf_dir):
    return st.join_coordinates(_matches(spark, sf_dir), st.features(table(spark, sf_dir, "keypoints"))).select(
        "view_i", "view_j", "match_idx", "feat_i", "feat_j", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")]
    )


def match_join_metadata(spark, sf_dir):
    pairs = _matches(spark, sf_dir).groupBy("view_i", "view_j").agg(F.count(F.lit(1)).alias("n_matches"))
    return st.join_metadata(pairs, _images(spark, sf_dir))


def match_bearing_pairs(spark, sf_dir):
    located = st.join_coordinates(_matches(spark, sf_dir), st.features(table(spark, sf_dir, "keypoints")))
    out = st.bearing_pairs(located, _images(spark, sf_dir), st.intrinsics(table(spark, sf_dir, "cameras")), inliers_only=True)
    return out.select("view_i", "view_j", "match_idx", *_array("b1", 3), *_array("b2", 3))


def match_point_lists(spark, sf_dir):
    located = st.join_coordinates(_matches(spark, sf_dir).filter("is_inlier"), st.features(table(spark, sf_dir, "keypoints")))
    lists = st.point_lists(located)
    return lists.select("view_i", "view_j", F.size("points_i").alias("n"), F.round(F.col("points_i")[0][0], 3).alias("first_x"), F.round(F.col("points_j")[F.size("points_j") - 1][1], 3).alias("last_y"))


def name_lookup_join(spark, sf_dir):
    known = _images(spark, sf_dir).select("name", "image_id")
    files = table(spark, sf_dir, "model_images").select("name").filter("name IS NOT NULL").distinct()
    return st.lookup_names(files, "name", known, "name", "image_id")[0]


def name_lookup_miss(spark, sf_dir):
    known = _images(spark, sf_dir).select("name", "image_id")
    files = table(spark, sf_dir, "model_images").select("name").filter("name IS NOT NULL").distinct()
    return st.lookup_names(files, "name", known, "name", "image_id")[1]


def name_parts(spark, sf_dir):
    return _images(spark, sf_dir).filter("name IS NOT NULL").select("image_id", strip_extension(base_name(F.col("name"))).alias("stem"), dataset_name(F.regexp_replace("name", "/[^/]*$", "/images")).alias("dataset"))


def pair_id_roundtrip(spark, sf_dir):
    pairs = _matches(spark, sf_dir).select("view_i", "view_j").distinct().withColumn("pair", pair_id(F.col("view_i"), F.col("view_j")))
    first, second = split_pair_id(F.col("pair"))
    return pairs.select("view_i", "view_j", "pair", first.alias("first"), second.alias("second"))


def filter_min_matches(spark, sf_dir):
    out = st.keep_matched_pairs(_matches(spark, sf_dir), least=2)
    return out.select("view_i", "view_j", "match_idx", "feat_i", "feat_j", "n_matches", "kept", "is_inlier")


def filter_pair_problems(spark, sf_dir):
    quality = st.pair_quality(_matches(spark, sf_dir))
    return st.pair_problems(quality, _images(spark, sf_dir).select(F.col("image_id").alias("view_id")))


def filter_quality(spark, sf_dir):
    return st.pair_quality(_matches(spark, sf_dir), least=2, solver=1)


def pixel_in_image(spark, sf_dir):
    located = st.features(table(spark, sf_dir, "keypoints")).join(_images(spark, sf_dir).select(F.col("image_id").alias("view_id"), "camera_id"), "view_id")
    seen = located.join(st.intrinsics(table(spark, sf_dir, "cameras")), "camera_id")
    inside = g.pixel_in_image(F.col("x"), F.col("y"), F.col("width"), F.col("height")) & ~F.isnan("x") & ~F.isnan("y")
    return seen.groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"))


def keypoint_rescale(spark, sf_dir):
    return st.rescale(st.features(table(spark, sf_dir, "keypoints")), 0.5).select("view_id", "feature_id", F.round("x", 4).alias("x"), F.round("size", 4).alias("size"))


def inlier_sync(spark, sf_dir):
    m = _matches(spark, sf_dir).groupBy("view_i", "view_j", "match_idx").agg(F.max("is_inlier").alias("is_inlier"))
    order = Window.partitionBy("view_i", "view_j").orderBy("match_idx")
    found = m.filter("is_inlier").select("view_i", "view_j", (F.row_number().over(order) - 1).alias("nth")).withColumn("ok", F.col("nth") % 2 == 0)
    return st.sync_inliers(m, found)


def image_points(spark, sf_dir):
    return st.image_points(st.observations(table(spark, sf_dir, "points3d")))


def valid_views(spark, sf_dir):
    return st.valid_views(st.observations(table(spark, sf_dir, "points3d")))


def all_pairs_views(spark, sf_dir):
    images = _images(spark, sf_dir).withColumn("scene", F.substring_index("name", "/", 1))
    return st.view_pairs(images, "image_id", "scene")


def shared_camera(spark, sf_dir):
    camera = st.intrinsics(table(spark, sf_dir, "cameras")).filter("fx IS NOT NULL").orderBy("camera_id").limit(1).select("fx", "cx")
    return st.with_shared_camera(_images(spark, sf_dir).select("image_id"), camera)


def _observed(spark, sf_dir):
    """Line items as observations: the order is the track, the supplier the view."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track_id"), F.row_number().over(order).alias("obs_idx"), F.col("l_suppkey").alias("view_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"),
        (F.col("l_returnflag") != "R").alias("is_used"), F.col("l_extendedprice").alias("price"),
    )


def coord_change(spark, sf_dir):
    before = _observed(spark, sf_dir)
    after = before.withColumn("x", F.col("x") + F.col("obs_idx") % 3).withColumn("y", F.col("y") * 2).withColumn("is_used", F.col("obs_idx") % 5 != 0)
    out = st.coordinate_change(before, after)
    return out.select("n", F.round("half_sum", 2).alias("half_sum"), F.round("mean", 6).alias("mean"))


def track_colour_mean(spark, sf_dir):
    out = st.track_means(_observed(spark, sf_dir), ["x", "y", "price"])
    return out.select("track_id", "n_used", *[F.round(c, 9).alias(c) for c in ("mean_x", "mean_y", "mean_price")])


def scene_scale(spark, sf_dir):
    p = st.poses(table(spark, sf_dir, "images")).withColumn("c", g.camera_centre(F.col("r"), F.col("t"))).withColumn("scene", F.substring_index("name", "/", 1))
    centres = p.select("view_id", "scene", *[F.col("c")[i].alias(n) for i, n in enumerate("xyz")])
    return st.scene_scale(centres, "scene", "x", "y", "z", "view_id").select("scene", *[F.round(c, 6).alias(c) for c in ("greatest", "least", "scale")])


def upper_median_stats(spark, sf_dir):
    errors = table(spark, sf_dir, "points3d").distinct().withColumn("is_used", F.coalesce("is_used", F.lit(False)))
    out = robust.summary_with_upper_median(errors, ["is_used"], "error")
    return out.select("is_used", "n", *[F.round(c, 6).alias(c) for c in ("min", "mean", "max", "upper_median")])


def x84_outliers(spark, sf_dir):
    errors = table(spark, sf_dir, "points3d").select("point_id", "error", "added_at").distinct()
    out = robust.x84(errors, [], "error")
    return out.groupBy("is_inlier").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("threshold"), 6).alias("threshold"))


def grid_distributed_topk(spark, sf_dir):
    rows = _observed(spark, sf_dir).select("view_id", "x", "price", "is_used", (F.col("track_id") * 100 + F.col("obs_idx")).alias("idx"))
    return selection.spread_selection(rows, ["view_id"], F.col("x"), F.col("price"), 50.0, 60000.0, "idx", F.col("is_used"), 100)


def pose_rotation(spark, sf_dir):
    return st.poses(table(spark, sf_dir, "images")).select("view_id", *_array("r", 9))


def pose_centre(spark, sf_dir):
    p = st.poses(table(spark, sf_dir, "images")).withColumn("c", g.camera_centre(F.col("r"), F.col("t")))
    return p.select("view_id", *_array("c", 3))


def pose_sanity(spark, sf_dir):
    p = st.poses(table(spark, sf_dir, "images"))
    return p.select("view_id", g.pose_is_sane(F.col("r"), F.col("t")).alias("sane"), (F.round(g.determinant(F.col("r")), 6)).alias("det"))


def pose_format_convert(spark, sf_dir):
    p = st.poses(table(spark, sf_dir, "images"))
    r, t = g.convert_pose(F.col("r"), F.col("t"), "RwTc", "RcTw")
    back = g.convert_pose(r, t, "RcTw", "RwTc")[1]
    return p.select("view_id", r.alias("r"), t.alias("c"), back.alias("t")).select("view_id", *_array("r", 3), *_array("c", 3), *_array("t", 3))


def quaternion_roundtrip(spark, sf_dir):
    p = st.poses(table(spark, sf_dir, "images")).select("view_id", "q", g.rotation_to_quaternion(F.col("r")).alias("b"))
    return p.select("view_id", F.round(F.abs(g.dot(F.col("q"), F.col("b"), 4)), 6).alias("agreement"))


def axis_angle_roundtrip(spark, sf_dir):
    p = st.poses(table(spark, sf_dir, "images")).select("view_id", "r", g.quaternion_to_angle_axis(F.col("q")).alias("v"))
    return p.select("view_id", F.round(g.norm(F.col("v")), 6).alias("angle"), F.round(g.frobenius(g.angle_axis_to_rotation(F.col("v")), F.col("r")), 6).alias("residual"))


def euler_zyx(spark, sf_dir):
    p = st.poses(table(spark, sf_dir, "images")).withColumn("e", g.rotation_to_euler_zyx(F.col("r")))
    return p.select("view_id", *_array("e", 3, 5))


def cayley_roundtrip(spark, sf_dir):
    p = st.poses(table(spark, sf_dir, "images")).withColumn("c", g.rotation_to_cayley(F.col("r")))
    return p.filter("c IS NOT NULL AND abs(q[0]) > 0.01").select("view_id", *_array("c", 3, 4), F.round(g.frobenius(g.cayley_to_rotation(F.col("c")), F.col("r")), 5).alias("residual"))


def pixel_to_bearing(spark, sf_dir):
    f = st.features(table(spark, sf_dir, "keypoints")).join(_images(spark, sf_dir).select(F.col("image_id").alias("view_id"), "camera_id"), "view_id")
    f = f.join(st.intrinsics(table(spark, sf_dir, "cameras")), "camera_id").withColumn("b", g.bearing(*[F.col(c) for c in ("x", "y", "fx", "fy", "cx", "cy")]))
    return f.filter("b IS NOT NULL").filter(~F.isnan(F.col("b")[0])).select("view_id", "feature_id", *_array("b", 3))


def relpose_from_global(spark, sf_dir):
    return _relative(spark, sf_dir).select("view_i", "view_j", *_array("r", 9), *_array("t", 3))


def essential_matrices(spark, sf_dir):
    rel = _relative(spark, sf_dir).withColumn("e", g.essential_matrix(F.col("r"), F.col("t")))
    return rel.select("view_i", "view_j", *_array("e", 9, 5))


def pose_errors(spark, sf_dir):
    out = st.pose_errors(st.poses(table(spark, sf_dir, "model_images")), st.poses(table(spark, sf_dir, "images")))
    return out.select("view_id", *[F.round(c, 4).alias(c) for c in ("rotation_error", "direction_error", "position_error")])


def relpose_errors(spark, sf_dir):
    pairs = _matches(spark, sf_dir).select("view_i", "view_j").distinct()
    truth, found = (st.relative_poses(pairs, st.poses(table(spark, sf_dir, t))) for t in ("images", "model_images"))
    return st.relative_pose_errors(found, truth).select("view_i", "view_j", *[F.round(c, 4).alias(c) for c in ("rotation_error", "direction_error")])


def best_pose_candidate(spark, sf_dir):
    errors = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.abs(F.col("l_quantity") - 25), 4).alias("error"))
    return st.best_candidate(errors, ["l_orderkey"], "l_suppkey", "error")


def normalised_centres(spark, sf_dir):
    p = st.poses(table(spark, sf_dir, "images")).withColumn("c", g.camera_centre(F.col("r"), F.col("t"))).withColumn("scene", F.substring_index("name", "/", 1)).filter("scene IS NOT NULL")
    p = p.select("view_id", "scene", *[F.col("c")[i].alias(n) for i, n in enumerate("xyz")])
    return st.normalise_centres(p, ["scene"], ["x", "y", "z"]).select("view_id", "scene", *[F.round(c, 6).alias(c) for c in "xyz"])


QUERIES = {
    f.__name__: f
    for f in (
        stats_features, stats_matches, match_inlier_split, stats_tracks, stats_points, stats_relposes, stats_global_poses, stats_package, match_join_coordinates, match_join_metadata, match_bearing_pairs,
        match_point_lists, name_lookup_join, name_lookup_miss, name_parts, pair_id_roundtrip, filter_min_matches, filter_pair_problems, filter_quality, pixel_in_image, keypoint_rescale, inlier_sync,
        image_points, valid_views, all_pairs_views, shared_camera, coord_change, track_colour_mean, scene_scale, upper_median_stats, x84_outliers, grid_distributed_topk, pose_rotation, pose_centre,
        pose_sanity, pose_format_convert, quaternion_roundtrip, axis_angle_roundtrip, euler_zyx, cayley_roundtrip, pixel_to_bearing, relpose_from_global, essential_matrices, pose_errors, relpose_errors,
        best_pose_candidate, normalised_centres,
    )
}

_M = "(SELECT DISTINCT * FROM matches)"
_IM = "(SELECT image_id, name, camera_id FROM images WHERE image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY added_at DESC NULLS LAST, name DESC NULLS LAST, camera_id DESC NULLS LAST) = 1)"
_FEATURES = """(SELECT image_id AS view_id, kp_idx::BIGINT AS feature_id, kp_id, CASE WHEN NOT isnan(x) THEN x::DOUBLE END AS x, CASE WHEN NOT isnan(y) THEN y::DOUBLE END AS y, CASE WHEN NOT isnan(scale) THEN scale::DOUBLE END AS size FROM keypoints WHERE image_id IS NOT NULL AND kp_idx IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY image_id, kp_idx ORDER BY added_at DESC NULLS LAST, kp_id DESC, keypoints.x DESC NULLS LAST, keypoints.y DESC NULLS LAST, keypoints.scale DESC NULLS LAST, orientation DESC NULLS LAST) = 1)"""
_OBS = """(SELECT point_id AS track_id, i - 1 AS obs_idx, track[i].image_id AS view_id, track[i].point2d_idx::BIGINT AS feature_id, coalesce(is_used, false) AS is_used
 FROM (SELECT DISTINCT point_id, is_used, track FROM points3d), LATERAL (SELECT unnest(range(1, len(track) + 1)) AS i) WHERE track[i].image_id IS NOT NULL AND track[i].point2d_idx IS NOT NULL)"""
_CAMERAS = """(SELECT camera_id, width, height, CASE WHEN len(params) >= 4 THEN params[1] END AS fx, CASE WHEN len(params) >= 4 THEN CASE WHEN single THEN params[1] ELSE params[2] END END AS fy,
 CASE WHEN len(params) >= 4 THEN CASE WHEN single THEN params[2] ELSE params[3] END END AS cx, CASE WHEN len(params) >= 4 THEN CASE WHEN single THEN params[3] ELSE params[4] END END AS cy
 FROM (SELECT *, model IN (2, 3, 4) AND len(params) <> 4 AS single FROM cameras WHERE camera_id IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY added_at DESC NULLS LAST, model DESC NULLS LAST, width DESC NULLS LAST, height DESC NULLS LAST, params DESC NULLS LAST) = 1))"""


def _poses_sql(t: str) -> str:
    """Poses with quaternion w, x, y, z, rotation r0..r8 and translation t0..t2 in columns."""
    good = f"""(SELECT * FROM (SELECT * FROM {t} WHERE image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY added_at DESC NULLS LAST) = 1)
      WHERE len(qvec) = 4 AND len(tvec) = 3 AND len(list_filter(qvec, lambda v: v IS NULL OR isnan(v))) = 0 AND len(list_filter(tvec, lambda v: v IS NULL OR isnan(v))) = 0)"""
    unit = f"""(SELECT image_id AS view_id, name, camera_id, qvec[1] / n AS w, qvec[2] / n AS x, qvec[3] / n AS y, qvec[4] / n AS z, tvec[1] AS t0, tvec[2] AS t1, tvec[3] AS t2
      FROM (SELECT *, sqrt(qvec[1] * qvec[1] + qvec[2] * qvec[2] + qvec[3] * qvec[3] + qvec[4] * qvec[4]) AS n FROM {good}) WHERE n > 1e-12)"""
    return f"""(SELECT *, -(r0 * t0 + r3 * t1 + r6 * t2) AS c0, -(r1 * t0 + r4 * t1 + r7 * t2) AS c1, -(r2 * t0 + r5 * t1 + r8 * t2) AS c2 FROM (SELECT *,
      1 - 2 * (y * y + z * z) AS r0, 2 * (x * y - w * z) AS r1, 2 * (x * z + w * y) AS r2, 2 * (x * y + w * z) AS r3, 1 - 2 * (x * x + z * z) AS r4, 2 * (y * z - w * x) AS r5,
      2 * (x * z - w * y) AS r6, 2 * (y * z + w * x) AS r7, 1 - 2 * (x * x + y * y) AS r8 FROM {unit}))"""


_P = _poses_sql("images")


def _rel_sql(t: str, pairs: str = "(SELECT DISTINCT view_i, view_j FROM matches)") -> str:
    r = ", ".join(f"b.r{3 * i} * a.r{3 * j} + b.r{3 * i + 1} * a.r{3 * j + 1} + b.r{3 * i + 2} * a.r{3 * j + 2} AS r{3 * i + j}" for i in range(3) for j in range(3))
    t_ = ", ".join(f"u{i} - (r{3 * i} * s0 + r{3 * i + 1} * s1 + r{3 * i + 2} * s2) AS t{i}" for i in range(3))
    rows = f"""(SELECT view_i, view_j, {r}, a.t0 AS s0, a.t1 AS s1, a.t2 AS s2, b.t0 AS u0, b.t1 AS u1, b.t2 AS u2
      FROM {pairs} JOIN {_poses_sql(t)} a ON a.view_id = view_i JOIN {_poses_sql(t)} b ON b.view_id = view_j)"""
    return f"(SELECT view_i, view_j, {', '.join(f'r{k}' for k in range(9))}, {t_} FROM {rows})"


def _shown(prefix: str, n: int, digits: int = 6, source: str | None = None) -> str:
    return ", ".join(f"round({source or prefix}{i}, {digits}) + 0.0 AS {prefix}{i}" for i in range(n))


_IDENTITY = " + ".join(f"(r{k} - {float(k % 4 == 0)}) * (r{k} - {float(k % 4 == 0)})" for k in range(9))
_ANGLE = "degrees(acos(greatest(least(((" + " + ".join(f"e.r{k} * g.r{k}" for k in range(9)) + ") - 1) / 2, 1.0), -1.0)))"
_DIRECTION = """CASE WHEN sqrt(e.t0 * e.t0 + e.t1 * e.t1 + e.t2 * e.t2) * sqrt(g.t0 * g.t0 + g.t1 * g.t1 + g.t2 * g.t2) > 1e-12 THEN degrees(acos(greatest(least((e.t0 * g.t0 + e.t1 * g.t1 + e.t2 * g.t2)
 / (sqrt(e.t0 * e.t0 + e.t1 * e.t1 + e.t2 * e.t2) * sqrt(g.t0 * g.t0 + g.t1 * g.t1 + g.t2 * g.t2)), 1.0), -1.0))) END"""
_OBSERVED = """(SELECT l_orderkey AS track_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS obs_idx,
 l_suppkey AS view_id, l_quantity AS x, l_discount AS y, l_returnflag <> 'R' AS is_used, l_extendedprice AS price FROM lineitem)"""
_LOCATED = f"""(SELECT m.*, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {_M} m JOIN {_FEATURES} a ON a.view_id = view_i AND a.feature_id = feat_i JOIN {_FEATURES} b ON b.view_id = view_j AND b.feature_id = feat_j)"""
_PAIR_COUNTS = f"(SELECT view_i, view_j, count(*) AS n, count(*) FILTER (is_inlier) AS ok FROM {_M} GROUP BY ALL)"
_FS = f"SELECT coalesce(sum(n), 0)::BIGINT AS n_features, count(*) AS n_images, round(avg(n), 6) AS mean_features FROM (SELECT view_id, count(*) AS n FROM {_FEATURES} GROUP BY view_id)"
_MS = f"SELECT count(*) AS n_pairs, coalesce(sum(n), 0)::BIGINT AS n_matches, round(avg(n), 6) AS mean_matches, coalesce(sum(ok), 0)::BIGINT AS n_inliers, count(*) FILTER (ok > 0) AS n_pairs_with_inliers FROM {_PAIR_COUNTS}"
_TS = f"""SELECT count(*) AS n_tracks, count(*) FILTER (n >= 2) AS n_multi_view, coalesce(sum(n), 0)::BIGINT AS n_observations, coalesce(sum(used), 0)::BIGINT AS n_used, round(sum(used) / nullif(sum(n), 0), 6) AS used_ratio
 FROM (SELECT track_id, count(*) AS n, count(*) FILTER (is_used) AS used FROM {_OBS} GROUP BY track_id)"""
_PS = "SELECT count(*) AS n_points, count(*) FILTER (is_used) AS n_used FROM (SELECT DISTINCT * FROM points3d)"


def _unpivot(data: str, sql: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{data}' AS data, '{n}' AS metric, round({n}::DOUBLE, 6) AS value FROM ({sql})" for n in names)


def _bearing_sql(n: str, c: str) -> str:
    x, y = f"(x{n} - {c}.cx) / {c}.fx", f"(y{n} - {c}.cy) / {c}.fy"
    length = f"sqrt(({x}) * ({x}) + ({y}) * ({y}) + 1)"
    return f"round({x} / {length}, 6) + 0.0 AS b{n}0, round({y} / {length}, 6) + 0.0 AS b{n}1, round(1 / {length}, 6) + 0.0 AS b{n}2"


def _upper_sql(rows: str) -> str:
    return f"list_sort(list({rows}))[len(list({rows})) // 2 + 1]"


_ERRORS = "(SELECT DISTINCT point_id, error, added_at FROM points3d)"
_CELL = "(greatest(least(floor(price / (60000.0 / 6))::INT, 5), 0) * 8 + greatest(least(floor(x / (50.0 / 8))::INT, 7), 0))"

SQL = {
    "stats_features": _FS,
    "stats_matches": _MS,
    "match_inlier_split": f"SELECT count(*) AS total, count(*) FILTER (is_inlier) AS inliers, count(*) FILTER (NOT coalesce(is_inlier, false)) AS outliers FROM {_M}",
    "stats_tracks": _TS,
    "stats_points": _PS,
    "stats_relposes": f"""SELECT n_pairs, n_valid, floor(sqrt(2.0 * n_pairs) + 1)::BIGINT AS n_views, round(n_pairs / (floor(sqrt(2.0 * n_pairs) + 1) * (floor(sqrt(2.0 * n_pairs) + 1) - 1) / 2), 9) AS coverage
        FROM (SELECT count(*) AS n_pairs, count(*) FILTER (sqrt({_IDENTITY}) > 1e-9 AND sqrt(t0 * t0 + t1 * t1 + t2 * t2) > 1e-12) AS n_valid FROM {_rel_sql("images")})""",
    "stats_global_poses": f"SELECT count(*) AS n_poses, count(*) AS n_valid FROM {_P}",
    "stats_package": " UNION ALL ".join([
        _unpivot("data_features", _FS, ["n_features", "n_images", "mean_features"]), _unpivot("data_matches", _MS, ["n_pairs", "n_matches", "mean_matches", "n_inliers", "n_pairs_with_inliers"]),
        _unpivot("data_tracks", _TS, ["n_tracks", "n_multi_view", "n_observations", "n_used", "used_ratio"]), _unpivot("data_points_3d", _PS, ["n_points", "n_used"]),
    ]),
    "match_join_coordinates": f"SELECT view_i, view_j, match_idx, feat_i, feat_j, round(x1, 3) AS x1, round(y1, 3) AS y1, round(x2, 3) AS x2, round(y2, 3) AS y2 FROM {_LOCATED}",
    "match_join_metadata": f"""SELECT view_i, view_j, n AS n_matches, a.name AS name_i, a.camera_id AS camera_i, b.name AS name_j, b.camera_id AS camera_j
        FROM {_PAIR_COUNTS} JOIN {_IM} a ON a.image_id = view_i JOIN {_IM} b ON b.image_id = view_j""",
    "match_bearing_pairs": f"""SELECT view_i, view_j, match_idx, {_bearing_sql("1", "ca")}, {_bearing_sql("2", "cb")} FROM {_LOCATED} m JOIN {_IM} a ON a.image_id = view_i JOIN {_IM} b ON b.image_id = view_j
        JOIN {_CAMERAS} ca ON ca.camera_id = a.camera_id JOIN {_CAMERAS} cb ON cb.camera_id = b.camera_id WHERE is_inlier AND ca.fx > 0 AND ca.fy > 0 AND cb.fx > 0 AND cb.fy > 0
        AND NOT isnan(x1) AND NOT isnan(x2) AND x1 IS NOT NULL AND x2 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL AND NOT isnan(y1) AND NOT isnan(y2)""",
    "match_point_lists": f"""SELECT view_i, view_j, count(*)::INT AS n, round((list(x1 ORDER BY match_idx, x1, y1, x2, y2))[1], 3) AS first_x, round((list(y2 ORDER BY match_idx, x1, y1, x2, y2))[-1], 3) AS last_y
        FROM {_LOCATED} WHERE is_inlier GROUP BY view_i, view_j""",
    "name_lookup_join": f"SELECT f.name, i.image_id AS view_id FROM (SELECT DISTINCT name FROM model_images WHERE name IS NOT NULL) f JOIN {_IM} i USING (name)",
    "name_lookup_miss": f"SELECT DISTINCT name FROM model_images WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM {_IM} WHERE name IS NOT NULL)",
    "name_parts": f"""SELECT image_id, regexp_replace(regexp_extract(name, '([^/\\\\]*)[/\\\\]*$', 1), '\\.[^./\\\\]*$', '') AS stem,
        CASE WHEN contains(name, '/') THEN regexp_extract(regexp_replace(name, '/[^/]*$', ''), '([^/\\\\]+)[/\\\\]*$', 1) ELSE regexp_extract(regexp_replace(name, '[/\\\\]+$', ''), '([^/\\\\]+)$', 1) END AS dataset
        FROM {_IM} WHERE name IS NOT NULL""",
    "pair_id_roundtrip": "SELECT DISTINCT view_i, view_j, least(view_i, view_j) * 2147483647 + greatest(view_i, view_j) AS pair, least(view_i, view_j) AS first, greatest(view_i, view_j) AS second FROM matches",
    "filter_min_matches": f"SELECT view_i, view_j, match_idx, feat_i, feat_j, n AS n_matches, n >= 2 AS kept, coalesce(is_inlier, false) AND n >= 2 AS is_inlier FROM {_M} JOIN {_PAIR_COUNTS} USING (view_i, view_j)",
    "filter_pair_problems": f"""SELECT CASE WHEN view_i NOT IN (SELECT image_id FROM {_IM}) OR view_j NOT IN (SELECT image_id FROM {_IM}) THEN 'out_of_range' WHEN ok = 0 THEN 'empty' ELSE 'ok' END AS reason,
        count(*) AS n_pairs FROM {_PAIR_COUNTS} GROUP BY 1""",
    "filter_quality": f"SELECT view_i, view_j, n AS n_matches, ok AS n_inliers, ok >= 2 AND ok / n >= 0.25 AS passed FROM {_PAIR_COUNTS}",
    "pixel_in_image": f"""SELECT camera_id, count(*) AS n, count(*) FILTER (x >= 0 AND x < width AND y >= 0 AND y < height AND NOT isnan(x) AND NOT isnan(y)) AS n_inside
        FROM {_FEATURES} f JOIN {_IM} i ON i.image_id = view_id JOIN {_CAMERAS} c USING (camera_id) GROUP BY camera_id""",
    "keypoint_rescale": f"SELECT view_id, feature_id, round(x * 0.5, 4) AS x, round(size * 0.5, 4) AS size FROM {_FEATURES}",
    "inlier_sync": """WITH m AS (SELECT view_i, view_j, match_idx, max(is_inlier) AS is_inlier FROM matches GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY view_i, view_j ORDER BY match_idx) - 1 AS nth FROM m WHERE is_inlier)
        SELECT view_i, view_j, match_idx, coalesce(nth % 2 = 0, false) AS is_inlier FROM m LEFT JOIN (SELECT view_i, view_j, match_idx, nth FROM n) USING (view_i, view_j, match_idx)""",
    "image_points": f"SELECT view_id, count(*) AS n_observations, count(*) FILTER (is_used) AS n_used, min(track_id) AS first_track, max(track_id) AS last_track FROM {_OBS} GROUP BY view_id",
    "valid_views": f"SELECT view_id, row_number() OVER (ORDER BY view_id) - 1 AS est_id FROM (SELECT DISTINCT view_id FROM {_OBS} WHERE is_used)",
    "all_pairs_views": f"SELECT a.image_id AS view_i, b.image_id AS view_j FROM {_IM} a JOIN {_IM} b ON split_part(a.name, '/', 1) = split_part(b.name, '/', 1) AND a.image_id < b.image_id",
    "shared_camera": f"SELECT image_id, fx, cx FROM {_IM}, (SELECT fx, cx FROM {_CAMERAS} WHERE fx IS NOT NULL ORDER BY camera_id LIMIT 1)",
    "coord_change": f"""SELECT count(*) AS n, round(sum(s) / 2, 2) AS half_sum, round(avg(s), 6) AS mean FROM (SELECT (obs_idx % 3) * (obs_idx % 3) + y * y AS s FROM {_OBSERVED} WHERE is_used AND obs_idx % 5 <> 0)""",
    "track_colour_mean": f"""SELECT track_id, count(*) FILTER (is_used) AS n_used, round(avg(x) FILTER (is_used), 9) AS mean_x, round(avg(y) FILTER (is_used), 9) AS mean_y, round(avg(price) FILTER (is_used), 9) AS mean_price
        FROM {_OBSERVED} GROUP BY track_id""",
    "scene_scale": f"""WITH s AS (SELECT split_part(name, '/', 1) AS scene, view_id, c0 AS x, c1 AS y, c2 AS z FROM {_P} WHERE name IS NOT NULL),
        d AS (SELECT a.scene, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM s a JOIN s b ON a.scene = b.scene AND a.view_id < b.view_id),
        k AS (SELECT * FROM d JOIN (SELECT scene, max(d) AS greatest FROM d GROUP BY scene) USING (scene) WHERE d >= 0.01 * greatest AND d > 0)
        SELECT scene, round(max(greatest), 6) AS greatest, round(min(d), 6) AS least, round(least(greatest(1 / min(d), 1e-6), 1e6), 6) AS scale FROM k GROUP BY scene""",
    "upper_median_stats": f"""SELECT is_used, count(*) AS n, round(min(error), 6) AS min, round(avg(error), 6) AS mean, round(max(error), 6) AS max, round({_upper_sql("error")}, 6) AS upper_median
        FROM (SELECT coalesce(is_used, false) AS is_used, error FROM (SELECT DISTINCT * FROM points3d) WHERE error IS NOT NULL AND NOT isnan(error)) GROUP BY is_used""",
    "x84_outliers": f"""WITH v AS (SELECT * FROM {_ERRORS} WHERE error IS NOT NULL AND NOT isnan(error)), m AS (SELECT {_upper_sql("error")} AS m FROM v), s AS (SELECT {_upper_sql("abs(error - m)")} AS s FROM v, m)
        SELECT coalesce(error < m + 5.2 * s AND NOT isnan(error), false) AS is_inlier, count(*) AS n, round(max(m + 5.2 * s), 6) AS threshold FROM {_ERRORS}, m, s GROUP BY 1""",
    "grid_distributed_topk": f"""WITH r AS (SELECT view_id, track_id * 100 + obs_idx AS idx, {_CELL}::INT AS cell, is_used AS ok FROM {_OBSERVED}),
        z AS (SELECT view_id, cell, count(*) AS n, 2 + CASE WHEN row_number() OVER (PARTITION BY view_id ORDER BY cell) <= 4 THEN 1 ELSE 0 END AS quota FROM r GROUP BY view_id, cell),
        p AS (SELECT r.*, n, quota, row_number() OVER (PARTITION BY view_id, cell ORDER BY idx) - 1 AS place FROM r JOIN z USING (view_id, cell)),
        c AS (SELECT *, n <= quota OR list_contains([(i * n) // quota FOR i IN range(quota)], place) AS chosen FROM p),
        k AS (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY chosen DESC, idx) AS take FROM c)
        SELECT view_id, idx, cell, row_number() OVER (PARTITION BY view_id ORDER BY ok DESC, idx)::INT AS rank FROM k WHERE take <= 100""",
    "pose_rotation": f"SELECT view_id, {_shown('r', 9)} FROM {_P}",
    "pose_centre": f"SELECT view_id, {_shown('c', 3)} FROM {_P}",
    "pose_format_convert": f"SELECT view_id, round(r0, 6) + 0.0 AS r0, round(r3, 6) + 0.0 AS r1, round(r6, 6) + 0.0 AS r2, {_shown('c', 3)}, {_shown('t', 3)} FROM {_P}",
    "pose_sanity": f"SELECT view_id, true AS sane, 1.0::DOUBLE AS det FROM {_P}",
    "quaternion_roundtrip": f"SELECT view_id, 1.0::DOUBLE AS agreement FROM {_P}",
    "axis_angle_roundtrip": f"SELECT view_id, round(2 * atan2(sqrt(x * x + y * y + z * z), abs(w)), 6) AS angle, 0.0::DOUBLE AS residual FROM {_P}",
    "euler_zyx": f"SELECT view_id, round(degrees(atan2(r7, r8)), 5) + 0.0 AS e0, round(degrees(atan2(-r6, sqrt(r0 * r0 + r3 * r3))), 5) + 0.0 AS e1, round(degrees(atan2(r3, r0)), 5) + 0.0 AS e2 FROM {_P}",
    "cayley_roundtrip": f"SELECT view_id, round(x / w, 4) + 0.0 AS c0, round(y / w, 4) + 0.0 AS c1, round(z / w, 4) + 0.0 AS c2, 0.0::DOUBLE AS residual FROM {_P} WHERE abs(w) > 0.01",
    "pixel_to_bearing": f"""SELECT view_id, feature_id, {_bearing_sql("", "c").replace(" AS b0", " AS b0")} FROM {_FEATURES} f JOIN {_IM} i ON i.image_id = view_id JOIN {_CAMERAS} c ON c.camera_id = i.camera_id
        WHERE fx > 0 AND fy > 0 AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)""",
    "relpose_from_global": f"SELECT view_i, view_j, {_shown('r', 9)}, {_shown('t', 3)} FROM {_rel_sql('images')}",
    "essential_matrices": "SELECT view_i, view_j, " + ", ".join(f"round({a} * r{3 + c if i == 0 else c} {b}, 5) + 0.0 AS e{3 * i + c}" for i, c, a, b in [
        *[(0, c, "-t2", f"+ t1 * r{6 + c}") for c in range(3)], *[(1, c, "t2", f"- t0 * r{6 + c}") for c in range(3)], *[(2, c, "-t1", f"+ t0 * r{3 + c}") for c in range(3)]]) + f" FROM {_rel_sql('images')}",
    "pose_errors": f"""SELECT e.view_id, round({_ANGLE}, 4) AS rotation_error, round({_DIRECTION}, 4) AS direction_error,
        round(sqrt((e.c0 - g.c0) * (e.c0 - g.c0) + (e.c1 - g.c1) * (e.c1 - g.c1) + (e.c2 - g.c2) * (e.c2 - g.c2)), 4) AS position_error FROM {_poses_sql("model_images")} e JOIN {_P} g USING (view_id)""",
    "relpose_errors": f"SELECT e.view_i, e.view_j, round({_ANGLE}, 4) AS rotation_error, round({_DIRECTION}, 4) AS direction_error FROM {_rel_sql('model_images')} e JOIN {_rel_sql('images')} g USING (view_i, view_j)",
    "best_pose_candidate": """SELECT l_orderkey, (list(l_suppkey ORDER BY round(abs(l_quantity - 25), 4), l_suppkey))[1] AS l_suppkey, min(round(abs(l_quantity - 25), 4)) AS error FROM lineitem GROUP BY l_orderkey""",
    "normalised_centres": f"""WITH p AS (SELECT view_id, split_part(name, '/', 1) AS scene, c0, c1, c2 FROM {_P} WHERE name IS NOT NULL), m AS (SELECT scene, avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2 FROM p GROUP BY scene),
        d AS (SELECT view_id, scene, c0 - m0 AS x, c1 - m1 AS y, c2 - m2 AS z FROM p JOIN m USING (scene)), s AS (SELECT scene, sqrt(avg(x * x + y * y + z * z)) AS s FROM d GROUP BY scene)
        SELECT view_id, scene, round(x / nullif(s, 0), 6) AS x, round(y / nullif(s, 0), 6) AS y, round(z / nullif(s, 0), 6) AS z FROM d JOIN s USING (scene)""",
}
