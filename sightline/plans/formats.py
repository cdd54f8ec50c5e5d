"""Queries of sources and sinks: every format is written to the shared folder and read again."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import structure as st
from sightline.plans import reports as of_reports
from sightline.plans.model import _CAMERAS, _FEATURES, _IM, _M, _OBS, _P, _images, _matches, _rel_sql
from sightline.runtime import Staging, table
from sightline.sources import binary, reports, text

# names that stand in a line of their own format without quoting
PLAIN_NAME = "^[A-Za-z0-9_./-]+$"


def _folder(spark: SparkSession, purpose: str) -> str:
    return f"{Staging(spark, 'formats').path}/{purpose}"


def _local(path: str) -> str:
    """A path for formats of one file, which the driver writes; the shared folder must be mounted there."""
    plain = path.removeprefix("file://").removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"one-file formats need a mounted folder, not {path}")
    os.makedirs(os.path.dirname(plain), exist_ok=True)
    return plain


def _poses(spark, sf_dir) -> DataFrame:
    return st.poses(table(spark, sf_dir, "images")).filter(F.col("name").rlike(PLAIN_NAME))


def io_feature_text(spark, sf_dir):
    """Features of each view as ``x y scale orientation`` lines and back: their number and sums."""
    path = _folder(spark, "features")
    keypoints = table(spark, sf_dir, "keypoints").repartition("image_id")  # the rows of a view stay together until they are written
    text.write_feature_text(st.features(keypoints), path)
    back = text.read_feature_folder(spark, path)
    return back.groupBy("view_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("y"), 2).alias("y"))


def io_match_text(spark, sf_dir):
    path = _folder(spark, "matches")
    text.write_match_text(_matches(spark, sf_dir), path)
    return text.read_match_text(spark, path).select("view_i", "view_j", "feat_i", "feat_j")


def io_pose_text(spark, sf_dir):
    path = _folder(spark, "poses")
    text.write_poses(_poses(spark, sf_dir), path)
    return text.read_global_pose_text(spark, path).select("name", *[(F.col("r")[k] + F.lit(0.0)).alias(f"r{k}") for k in range(9)])


def io_pose_csv(spark, sf_dir):
    path = _folder(spark, "poses_csv")
    text.write_poses(_poses(spark, sf_dir), path, "csv")
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("image_id").cast("long").alias("image_id"), "name", *[(F.round(F.col(c).cast("double"), 5) + F.lit(0.0)).alias(c) for c in ("cx", "cy", "cz")])


def io_pose_json(spark, sf_dir):
    path = _folder(spark, "poses_json")
    text.write_poses(_poses(spark, sf_dir), path, "json")
    return spark.read.json(path).select(F.col("image_id").cast("long").alias("image_id"), "name", *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in ("tx", "ty", "tz")])


def io_g2o(spark, sf_dir):
    rel = st.relative_poses(_matches(spark, sf_dir).select("view_i", "view_j").distinct(), st.poses(table(spark, sf_dir, "images")))
    path = _folder(spark, "g2o")
    text.write_g2o(rel, path)
    edges = text.read_g2o(spark, path)[1].withColumn("r", g.quaternion_to_rotation(F.col("q")))
    return edges.select("view_i", "view_j", *[(F.round(F.col("t")[k], 5) + F.lit(0.0)).alias(f"t{k}") for k in range(3)], *[(F.round(F.col("r")[k], 5) + F.lit(0.0)).alias(f"r{k}") for k in range(9)])


def io_scene_json(spark, sf_dir):
    views = _images(spark, sf_dir).withColumn("scene", F.substring_index("name", "/", 1)).filter(F.col("name").rlike(PLAIN_NAME))
    views = views.select("scene", F.col("image_id").alias("view_id"), "name", F.lit(4).alias("width"), F.lit(3).alias("height"))
    poses = _poses(spark, sf_dir).select(F.substring_index("name", "/", 1).alias("scene"), "view_id", "r", g.camera_centre(F.col("r"), F.col("t")).alias("t"))
    path = _folder(spark, "scenes")
    text.write_scene_json(views, poses, path, "scene")
    found, placed = text.read_scene_json(spark, f"{path}/*/*")
    return found.join(placed.select("view_id", F.round(F.col("t")[0], 4).alias("c0")), "view_id", "left").select("view_id", "name", "width", (F.col("c0") + F.lit(0.0)).alias("c0"))


def _model(spark, sf_dir):
    points = table(spark, sf_dir, "points3d").groupBy("point_id").agg(*[F.max(c).alias(c) for c in ("x", "y", "z", "r", "g", "b", "error")])
    return binary.export_model(_poses(spark, sf_dir), st.features(table(spark, sf_dir, "keypoints")).select("view_id", "feature_id", "x", "y"), st.observations(table(spark, sf_dir, "points3d")), points)


def io_model_binary(spark, sf_dir):
    """A binary model with all features, observations and points, and its images read back."""
    images, points = _model(spark, sf_dir)
    no_place = lambda p: F.struct(F.coalesce(p["x"], F.lit(0.0)).alias("x"), F.coalesce(p["y"], F.lit(0.0)).alias("y"), p["point_id"].alias("point_id"))
    base = _local(_folder(spark, "model") + "/sparse/0/images.bin").removesuffix("/sparse/0/images.bin")
    cameras = st.intrinsics(table(spark, sf_dir, "cameras")).filter("width IS NOT NULL AND height IS NOT NULL AND fx IS NOT NULL").select("camera_id", F.lit(1).alias("model"), "width", "height", F.array("fx", "fy", "cx", "cy").alias("params"))
    binary.write_model_binary(f"{base}/sparse/0", cameras, images.withColumn("points", F.transform("points", no_place)), points)
    back = binary.read_model(spark, f"file://{base}")
    return back.select("image_id", "name", "camera_id", F.size("points").alias("n_points"), F.size(F.filter("points", lambda p: p["point_id"] >= 0)).alias("n_used"))


def io_database(spark, sf_dir):
    """A feature database of all tables, its keypoints, matches and poses read back and counted."""
    path = _local(_folder(spark, "database") + "/features.db")
    cameras = st.intrinsics(table(spark, sf_dir, "cameras")).filter("fx IS NOT NULL").select("camera_id", F.lit(1).alias("model"), "width", "height", F.array("fx", "fy", "cx", "cy").alias("params"))
    images = _images(spark, sf_dir).join(st.poses(table(spark, sf_dir, "images")).select(F.col("view_id").alias("image_id"), "q", "t"), "image_id", "left")
    features = st.features(table(spark, sf_dir, "keypoints")).filter("x IS NOT NULL AND y IS NOT NULL")
    numbered = features.select(F.col("view_id").alias("image_id"), F.col("feature_id").alias("kp_idx"), "x", "y")
    binary.write_database(path, cameras, images.select("image_id", "name", "camera_id", "q", "t"), numbered, _matches(spark, sf_dir))
    counts = [
        binary.read_database(spark, path, "keypoints").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 0).alias("total")),
        binary.read_database(spark, path, "matches").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("feat_i") + F.col("feat_j")).cast("double").alias("total")),
        binary.read_database(spark, path, "images").agg(F.count(F.lit(1)).alias("n"), F.sum("image_id").cast("double").alias("total")),
        binary.read_database(spark, path, "cameras").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("params")[0]), 0).alias("total")),
        binary.read_database(spark, path, "poses").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tx"), 2).alias("total")),
        binary.read_database(spark, path, "camera_poses").filter("qw IS NOT NULL AND params IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ty"), 2).alias("total")),
    ]
    out = None
    for name, df in zip(("keypoints", "matches", "images", "cameras", "poses", "camera_poses"), counts, strict=True):
        row = df.select(F.lit(name).alias("tbl"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


def io_ply(spark, sf_dir):
    """Used points as a point cloud: its vertices read back, by colour."""
    path = _folder(spark, "ply")
    points = table(spark, sf_dir, "points3d").distinct().filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").filter(F.coalesce("is_used", F.lit(False)))
    text.write_ply(points, path)
    part = F.split("value", " ")
    rows = spark.read.text(path).filter(F.col("value").rlike("^-?[0-9]+[.][0-9]{6} ")).select(part[3].cast("int").alias("red"), part[0].cast("double").alias("x"))
    return rows.groupBy("red").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 2).alias("x"))


def io_statistics_csv(spark, sf_dir):
    """The statistics report as CSV and back."""
    path = _folder(spark, "stats")
    reports.write_csv(of_reports.QUERIES["eval_all_stats"](spark, sf_dir), path)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.withColumn("count", F.col("count").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (io_feature_text, io_match_text, io_pose_text, io_pose_csv, io_pose_json, io_g2o, io_scene_json, io_model_binary, io_database, io_ply, io_statistics_csv)
}

_NAMED = f"(SELECT * FROM {_P} WHERE regexp_matches(name, '{PLAIN_NAME}'))"


def _round(columns: list[str], digits: int) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c.split('.')[-1]}" for c in columns)


_R, _T, _C = [f"r{k}" for k in range(9)], ["t0", "t1", "t2"], ["c0", "c1", "c2"]

SQL = {
    "io_statistics_csv": of_reports.SQL["eval_all_stats"],
    "io_feature_text": f"SELECT view_id, count(*) AS n, round(sum(round(coalesce(x, 0), 6)), 2) AS x, round(sum(round(coalesce(y, 0), 6)), 2) AS y FROM {_FEATURES} GROUP BY view_id",
    "io_match_text": f"SELECT view_i, view_j, feat_i, feat_j FROM {_M}",
    "io_pose_text": f"SELECT name, {_round(_R, 8)} FROM {_NAMED}",
    "io_pose_csv": f"SELECT view_id AS image_id, name, round(c0, 5) + 0.0 AS cx, round(c1, 5) + 0.0 AS cy, round(c2, 5) + 0.0 AS cz FROM {_NAMED}",
    "io_pose_json": f"SELECT view_id AS image_id, name, t0 + 0.0 AS tx, t1 + 0.0 AS ty, t2 + 0.0 AS tz FROM {_NAMED}",
    "io_g2o": f"SELECT view_i, view_j, {_round(_T, 5)}, {_round(_R, 5)} FROM {_rel_sql('images')}",
    "io_scene_json": f"SELECT i.image_id AS view_id, i.name, 4 AS width, round(p.c0, 4) + 0.0 AS c0 FROM {_IM} i LEFT JOIN {_NAMED} p ON p.view_id = i.image_id WHERE regexp_matches(i.name, '{PLAIN_NAME}')",
    "io_model_binary": f"""WITH u AS (SELECT DISTINCT view_id, feature_id FROM {_OBS} WHERE is_used), f AS (SELECT view_id, count(*) AS n, count(u.feature_id) AS used FROM {_FEATURES} LEFT JOIN u USING (view_id, feature_id) GROUP BY view_id)
        SELECT view_id::INT AS image_id, name, coalesce(camera_id, 0) AS camera_id, coalesce(n, 0)::INT AS n_points, coalesce(used, 0)::INT AS n_used FROM {_NAMED} LEFT JOIN f USING (view_id)""",
    "io_ply": "SELECT coalesce(r, 255)::INT AS red, count(*) AS n, round(sum(x), 2) AS x FROM (SELECT DISTINCT * FROM points3d) WHERE is_used AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1",
    "io_database": f"""WITH f AS (SELECT x::FLOAT::DOUBLE AS x FROM {_FEATURES} WHERE x IS NOT NULL AND y IS NOT NULL), c AS (SELECT camera_id, fx FROM {_CAMERAS} WHERE fx IS NOT NULL)
        SELECT 'keypoints' AS tbl, count(*) AS n, round(sum(x), 0) AS total FROM f
        UNION ALL SELECT 'matches', count(*), sum(feat_i + feat_j)::DOUBLE FROM {_M} WHERE view_i <> view_j
        UNION ALL SELECT 'images', count(*), sum(image_id)::DOUBLE FROM {_IM}
        UNION ALL SELECT 'cameras', count(*), round(sum(fx), 0) FROM c
        UNION ALL SELECT 'poses', count(*), round(sum(t0), 2) FROM {_P}
        UNION ALL SELECT 'camera_poses', count(*), round(sum(t1), 2) FROM {_P} p JOIN {_IM} i ON i.image_id = p.view_id JOIN c ON c.camera_id = i.camera_id""",
}
