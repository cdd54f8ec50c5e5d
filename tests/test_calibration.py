"""Calibration checks and conversions: nulls, NaN, empty tables, the rule that accepts at once."""

from pyspark.sql import functions as F

from sightline.operators import calibration as cal
from sightline.operators import structure as st

NAN = float("nan")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_calibration_is_valid(spark):
    good = (1, 500.0, 500.0, 320.0, 240.0, 640, 480, 0.5, 0.1)
    cases = [good, (2, -1.0, *good[2:]), (3, *good[1:3], 10.0, *good[4:]), (4, *good[1:8], 1.5), (5, *good[1:7], 9.0, 1.5), (6, None, *good[2:]), (7, NAN, *good[2:]), (8, *good[1:8], None), (9, *good[1:7], None, 0.1), (10, *good[1:7], NAN, 0.1)]
    df = spark.createDataFrame(cases, "id int, fx double, fy double, cx double, cy double, width int, height int, error double, k1 double")
    valid = cal.calibration_is_valid(*[F.col(c) for c in df.columns[1:]])
    assert {r[0] for r in df.select("id", valid.alias("v")).collect() if r["v"]} == {1, 5, 8}


def test_view_errors_and_totals(spark):
    df = spark.createDataFrame([(1, 3.0, 4.0), (1, None, 1.0), (1, NAN, 1.0), (2, 0.0, 0.0), (2, 6.0, 8.0)], "view_id long, dx double, dy double")
    assert rows(cal.view_errors(df, "view_id", "dx", "dy")) == [(1, 1, 5.0), (2, 2, 5.0)]
    assert rows(cal.greatest_view_error(df, "view_id", "dx", "dy")) == [(2, 5.0)] and rows(cal.greatest_view_error(df.limit(0), "view_id", "dx", "dy")) == [(0, None)]
    tried = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "view_i long, view_j long")
    found = spark.createDataFrame([(1, 2), (1, 2), (7, 8)], "view_i long, view_j long")
    assert rows(cal.match_totals(tried, found)) == [(2, 1, 2, 1)] and rows(cal.match_totals(tried.limit(0), found)) == [(0, 0, 0, 0)]


def test_conversions_and_coordinates(spark):
    names = spark.createDataFrame([(1, "flann"), (2, None), (3, "x")], "id int, v string")
    assert rows(names.select("id", cal.option_name(F.col("v"), "matcher"))) == [(1, "FLANN"), (2, "FASTCASCADEHASHINGL2"), (3, "FASTCASCADEHASHINGL2")]
    c = spark.createDataFrame([([5.0, 0.0, 3.0, 0.0, 6.0, 4.0, 0.0, 0.0, 1.0], [0.1, 0.2, 0.3, 0.4, 0.5]), ([5.0, 0.0, 3.0, 0.0, 6.0, 4.0, 0.0, 0.0, 1.0], [0.1])], "m array<double>, d array<double>")
    models = c.select(cal.camera_model(F.col("m"), F.col("d"), "BROWN_CONRADY").alias("c"))
    matrix, terms = cal.calibration(F.col("c"), "BROWN_CONRADY")
    back = models.select(matrix.alias("m"), terms.alias("d")).collect()
    assert back[0]["m"] == [5.0, 0.0, 3.0, 0.0, 6.0, 4.0, 0.0, 0.0, 1.0] and back[0]["d"] == [0.1, 0.2, 0.3, 0.4, 0.5] and back[1]["d"] == [0.0] * 5
    obs = spark.createDataFrame([(1, 1, 8.0, 16.0, "a"), (2, 1, None, 1.0, "b"), (3, 9, 1.0, 1.0, "c")], "track_id long, view_id long, x double, y double, fx string")
    cameras = spark.createDataFrame([(1, 5.0, 6.0, 3.0, 4.0)], "view_id long, fx double, fy double, cx double, cy double")
    normal = cal.normalise_observations(obs.drop("fx"), cameras)
    assert {r["track_id"]: (r["x"], r["y"]) for r in normal.collect()} == {1: (1.0, 2.0), 2: (None, -0.5), 3: (None, None)}
    assert {r["track_id"]: r["x"] for r in cal.restore_observations(normal, cameras).collect()} == {1: 8.0, 2: None, 3: None}
    assert {r["track_id"]: r["x"] for r in cal.reset_observations(normal).collect()} == {1: 8.0, 2: None, 3: 1.0}
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)], "point_id long, x double, y double, z double")
    assert rows(cal.point_errors(points, spark.createDataFrame([(1, 3.0, 4.0, 0.0), (5, 0.0, 0.0, 0.0)], "point_id long, x double, y double, z double"))) == [(1, 5.0)]
    m = spark.createDataFrame([(1, 2, 0, 5, 6, True)], "view_i long, view_j long, match_idx long, feat_i long, feat_j long, is_inlier boolean")
    assert rows(cal.from_index_matches(cal.to_index_matches(m))) == [(1, 2, 0, 5, 6, False)]


def test_match_totals_of_scenes_counts_pairs_and_lists_none(spark):
    views = spark.createDataFrame([(v, s) for s, ids in (("a", (1, 2, 3, 3)), ("b", (2, 3, 4)), ("c", (9,))) for v in ids] + [(5, None), (None, "a")], "view_id long, scene string")
    found = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 2), (1, 4), (9, 9), (3, 5)], "view_i long, view_j long")
    want = rows(cal.match_totals(st.view_pairs(views, "view_id", "scene"), found))
    assert rows(cal.scene_match_totals(views, "view_id", "scene", found)) == want == [(5, 2, 3, 3)]
    assert rows(cal.scene_match_totals(views.limit(0), "view_id", "scene", found)) == [(0, 0, 0, 0)]
    n = 300_000  # one scene, whose 45 billion pairs no one could list
    many = spark.range(n).select(F.col("id").alias("view_id"), F.lit("s").alias("scene"))
    assert rows(cal.scene_match_totals(many, "view_id", "scene", found)) == [(n * (n - 1) // 2, 4, 5, n * (n - 1) // 2 - 4)]
