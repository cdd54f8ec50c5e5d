"""Round trips of every format, the registry and the streams."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import registry
from sightline.functions.parsing import PAIR_BASE
from sightline.operators import methods  # noqa: F401
from sightline.sources import binary, reports, text
from sightline.streaming import events as stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_feature_and_match_text(spark, tmp_path):
    (tmp_path / "f.feat").write_text("1.5 2.5\n\nbad line\n3 4 0.5 90\n")
    assert rows(text.read_feature_text(spark, f"{tmp_path}/f.feat").select("x", "y", "size")) == [(1.5, 2.5, None), (3.0, 4.0, 0.5)]
    (tmp_path / "m.txt").write_text("0 1 2\n5 6\n7 8\n1 2 1\n9 9\n")
    assert rows(text.read_match_text(spark, f"{tmp_path}/m.txt")) == [(0, 1, 0, 5, 6, True), (0, 1, 1, 7, 8, True), (1, 2, 0, 9, 9, True)]
    folder = tmp_path / "mf"
    folder.mkdir()
    (folder / "matches_a_1_b.txt").write_text("1 1\n0 1 2 3\n4 5 6 7\n")
    (folder / "matches_x_y.txt").write_text("1 1\n0 1 2 3\n")
    names = spark.createDataFrame([("a_1.jpg", 1), ("b.jpg", 2)], "name string, view_id long")
    found, missed = text.read_match_folder(spark, str(folder), names)
    assert rows(found) == [(1, 2, 0, 0.0, 1.0, 2.0, 3.0), (1, 2, 1, 4.0, 5.0, 6.0, 7.0)] and missed.count() == 1


def test_ground_truth_poses_and_scene(spark, tmp_path):
    (tmp_path / "0003.jpg.camera").write_text("1 0 0\n0 1 0\n0 0 1\n0 0 0\n1 2 3\n4 5 6\n7 8 9\n10 11 12\n")
    (tmp_path / "0004.jpg.camera").write_text("1 0\n")
    gt = text.read_ground_truth(spark, f"{tmp_path}/*.camera").collect()
    assert len(gt) == 1 and gt[0]["view_id"] == 3 and gt[0]["r"] == [1.0, 4.0, 7.0, 2.0, 5.0, 8.0, 3.0, 6.0, 9.0] and gt[0]["t"] == [10.0, 11.0, 12.0]
    (tmp_path / "p.txt").write_text("# head\n\na.jpg 1 0 0 0 1 2 3\nb.jpg 0 0 0 2 0 0 0\n")
    poses = text.read_pose_text(spark, f"{tmp_path}/p.txt")
    assert {r["name"]: r["r"] for r in poses.collect()}["b.jpg"] == [-1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0]
    text.write_poses(poses, f"{tmp_path}/out")
    back = {r["name"]: (r["r"], r["t"]) for r in text.read_global_pose_text(spark, f"{tmp_path}/out").collect()}
    assert back == {r["name"]: (r["r"], r["t"]) for r in poses.collect()}
    (tmp_path / "s.json").write_text('{"root_path":"/r/","views":[{"key":0,"value":{"ptr_wrapper":{"data":{"local_path":"","filename":"a.jpg","width":4,"height":3,"id_view":0}}}}],'
                                     '"extrinsics":[{"key":0,"value":{"rotation":[[1,0,0],[0,1,0],[0,0,1]],"center":[1,1,1]}},{"key":0,"value":{"rotation":[[1,0,0],[0,1,0],[0,0,1]],"center":[2,2,2]}},{"key":1,"value":{}}]}')  # fmt: skip
    views, found = text.read_scene_json(spark, f"{tmp_path}/s.json")
    assert rows(views) == [(0, "a.jpg", "/r/a.jpg", 4, 3)] and found.collect()[0]["t"] == [2.0, 2.0, 2.0] and found.count() == 1


def test_g2o_and_ply(spark, tmp_path):
    rel = spark.createDataFrame([(0, 1, [0.0, -1, 0, 1, 0, 0, 0, 0, 1], [1.0, 2, 3])], "view_i long, view_j long, r array<double>, t array<double>")
    text.write_g2o(rel, f"{tmp_path}/g")
    edge = text.read_g2o(spark, f"{tmp_path}/g")[1].first()
    assert edge["t"] == [1.0, 2.0, 3.0] and np.allclose(edge["q"], [0.5**0.5, 0, 0, 0.5**0.5], atol=1e-8)
    points = spark.createDataFrame([(0.0, 1.0, 2.0, 1, 2, None, True), (0.0, 0.0, 0.0, 1, 1, 1, False)], "x double, y double, z double, r int, g int, b int, is_used boolean")
    text.write_ply(points, f"{tmp_path}/ply")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/ply").collect()]
    assert lines[0] == "ply" and "element vertex 1" in lines and lines[-1] == "0.000000 1.000000 2.000000 1 2 255"


def test_model_binary_and_text(spark, tmp_path):
    cameras = spark.createDataFrame([(1, 1, 640, 480, [500.0, 500.0, 320.0, 240.0])], "camera_id int, model int, width int, height int, params array<double>")
    images = spark.createDataFrame([(7, [1.0, 0, 0, 0], [1.0, 2, 3], 1, "a b.jpg", [(1.5, 2.5, 9), (0.0, 0.0, -1)]), (8, [1.0, 0, 0, 0], [0.0] * 3, 1, "c.jpg", [])], binary.MODEL_IMAGES)
    points = spark.createDataFrame([(9, 1.0, 2.0, 3.0, 1, 2, 3, 0.5, [(7, 0)])], "point_id long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:int,point2d_idx:int>>")
    binary.write_model_binary(f"{tmp_path}/sparse/0", cameras, images, points)
    assert binary.find_model(spark, str(tmp_path))[1] == "bin"
    assert rows(binary.read_model(spark, str(tmp_path))) == rows(images)
    (tmp_path / "images.txt").write_text("# c\n7 1 0 0 0 1 2 3 1 a b.jpg\n1.5 2.5 9 0 0 -1\n8 1 0 0 0 0 0 0 1 c.jpg\n\n")
    assert rows(text.read_model_images(spark, f"{tmp_path}/images.txt")) == rows(images)
    (tmp_path / "points3D.txt").write_text("9 1 2 3 1 2 3 0.5 7 0\n10 0 0 0 0 0 0 1\n")
    assert [len(r["track"]) for r in text.read_model_points(spark, f"{tmp_path}/points3D.txt").collect()] == [1, 0]
    (tmp_path / "cameras.txt").write_text("1 PINHOLE 640 480 500 500 320 240\n")
    assert text.read_model_cameras(spark, f"{tmp_path}/cameras.txt").first()["params"] == [500.0, 500.0, 320.0, 240.0]


def test_sqlite_database(spark, tmp_path):
    path = f"{tmp_path}/d.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE images (image_id INTEGER, name TEXT, camera_id INTEGER, qw REAL, qx REAL, qy REAL, qz REAL, tx REAL, ty REAL, tz REAL, prior_qw REAL, prior_qx REAL, prior_qy REAL, prior_qz REAL, prior_tx REAL, prior_ty REAL, prior_tz REAL)")
        con.execute("INSERT INTO images (image_id, name, camera_id, qw, qx, qy, qz) VALUES (1, 'a', 1, 1, 0, 0, 0)")
        con.execute("INSERT INTO images (image_id, name, camera_id, prior_qw, prior_qx, prior_qy, prior_qz, prior_tx) VALUES (2, 'b', 1, 0, 1, 0, 0, 5)")
        con.execute("INSERT INTO images (image_id, name, camera_id) VALUES (3, 'c', 1)")
        con.execute("CREATE TABLE keypoints (image_id INTEGER, rows INTEGER, cols INTEGER, data BLOB)")
        con.execute("INSERT INTO keypoints VALUES (1, 2, 4, ?)", (np.arange(8, dtype="<f4").tobytes(),))
        con.execute("INSERT INTO keypoints VALUES (2, 0, 4, NULL)")
        con.execute("CREATE TABLE matches (pair_id INTEGER, rows INTEGER, cols INTEGER, data BLOB)")
        con.execute("INSERT INTO matches VALUES (?, 2, 2, ?)", (1 * PAIR_BASE + 2, np.array([[0, 3], [1, 4]], "<u4").tobytes()))
    assert rows(binary.read_database(spark, path, "keypoints")) == [(1, 0, 0.0, 1.0), (1, 1, 4.0, 5.0)]
    assert rows(binary.read_database(spark, path, "matches")) == [(1, 2, 0, 0, 3, True), (1, 2, 1, 1, 4, True)]
    assert rows(binary.read_database(spark, path, "poses").select("image_id", "qw", "qx", "tx")) == [(1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 5.0)]


def test_reports_and_registry(spark, tmp_path):
    results = spark.createDataFrame([("t", "a", 1, "m", 1.0, {"n": "x"}), ("t", "b", 1, "m", 2.0, {})], "eval_type string, algorithm string, eval_commit int, metric string, value double, notes map<string,string>")
    reports.write_evaluation(results, str(tmp_path), [1], "n")
    both = reports.read_summaries(spark, {"one": f"{tmp_path}/t_m_ALL_STATS", "gone": f"{tmp_path}/nothing"})
    assert {(r["dataset"], r["algorithm"], r["mean"]) for r in both.collect()} == {("one", "a", "1.0"), ("one", "b", "2.0")}
    assert "match_features" in registry.names()
    with pytest.raises(KeyError):
        registry.method("nothing")
    with pytest.raises(ValueError):
        registry.build("match_features")
    features = spark.createDataFrame([(v, 10 * v + i, [float(i), 1.0]) for v in (0, 1) for i in range(3)], "view_id long, feature_id long, vec array<double>")
    assert registry.build("match_features", {"features": features}, ratio="0.9").count() == 3


def test_streams(spark, tmp_path):
    batch = spark.createDataFrame([(1, 90_000, 7, "a", 1.0), (1, 90_000, 7, "a", 1.0), (2, 90_060, 7, "b", 3.0), (3, 180_000, 8, "a", 5.0)], "event_id long, s long, user_id long, event_type string, value double")
    batch = batch.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    batch.write.parquet(f"{tmp_path}/in")
    source = stream.read_events(spark, f"{tmp_path}/in", batch.schema)
    for name, df, mode in (("stats", stream.windowed_stats(source), "append"), ("steps", stream.intervals(source.dropDuplicates(["event_id"])), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    assert {(r["event_type"], r["n"]) for r in spark.table("stats").collect()} == {("a", 1), ("b", 1)}
    assert rows(spark.table("steps")) == [(7, "a->b", 60000.0)]


def test_a_file_for_each_of_many_views(spark, tmp_path, monkeypatch):
    """As many files as views, written over what was there, without the committer's moves or a task for a few files."""
    monkeypatch.setattr(text, "FILES", 100)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "view_id=7000.txt").write_text("9 9 9 9\n")
    views = spark.range(-2, 498).selectExpr("id view_id", "explode(sequence(1L, 1 + abs(id) % 3)) feature_id")
    features = views.selectExpr("view_id", "feature_id", "view_id + 0.5D * feature_id x", "cast(null as double) y", "2D size", "1D angle")
    path = f"file://{tmp_path}/f"
    text.write_feature_text(features, path)
    assert len(list((tmp_path / "f").glob("*"))) == 500 and (tmp_path / "f/view_id=2.txt").read_text().splitlines()[1] == "3.000000 0.000000 2.000000 1.000000"
    back = text.read_feature_folder(spark, path)
    assert back.rdd.getNumPartitions() == 5
    want = rows(features.selectExpr("view_id", "feature_id - 1 line_no", "x", "0D y", "size", "angle"))
    assert rows(back.select("view_id", "line_no", "x", "y", "size", "angle")) == want
    assert rows(text.read_feature_text(spark, f"{path}/*").select("line_no", "x", "y", "size", "angle")) == rows(back.select("line_no", "x", "y", "size", "angle"))
