"""Camera calibrations and the forms in which features, matches and cameras come and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.structure import view_pairs

# A calibration with a greater error is accepted with a warning, and the greatest radial term else.
WARNING_ERROR, GREATEST_K1 = 2.0, 1.0
# Names of the options, the first being what an unknown name stands for.
OPTION_NAMES = {
    "matcher": ("FASTCASCADEHASHINGL2", "FLANN", "BF", "BF_NORM_L1", "BF_HAMMING", "LIGHTGLUE"),
    "run_mode": ("fast", "viewer"),
    "data_types": ("full", "single"),
    "sift_preset": ("CUSTOM", "NORMAL", "HIGH", "ULTRA"),
    "flann_algorithm": ("AUTO", "KDTREE", "LSH", "KMEANS", "COMPOSITE", "LINEAR"),
}
# Places of the radial and tangential terms in a coefficient vector, by distortion.
DISTORTIONS = {"NO_DISTORTION": ((), ()), "RADIAL_K1": ((0,), ()), "RADIAL_K3": ((0, 1, 4), ()), "BROWN_CONRADY": ((0, 1, 4), (2, 3))}


def calibration_is_valid(fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, error: Column, k1: Column) -> Column:
    """Whether a calibration is sane: positive focal lengths and a principal point within a quarter of the image around
    its middle (whole pixels); then a large ``error`` is accepted as it is, else the first radial term must be small.

    A null or NaN focal length, centre, size or error is not valid; a null ``k1`` stands for no distortion.
    """
    def central(c: Column, size: Column) -> Column:
        return F.abs(c - F.floor(size / 2)) <= F.floor(size / 4)

    sane = (fx > 0) & (fy > 0) & ~F.isnan(fx) & ~F.isnan(fy) & central(cx, width) & central(cy, height)
    return F.coalesce(sane & error.isNotNull() & ~F.isnan(error) & ((error > WARNING_ERROR) | k1.isNull() | (F.abs(k1) <= GREATEST_K1)), F.lit(False))


def view_errors(residuals: DataFrame, view: str, dx: str, dy: str) -> DataFrame:
    """``view, n, error``: the norm of all displacements of each view, divided by their number; nulls and NaN do not count."""
    square = F.col(dx).cast("double") * F.col(dx).cast("double") + F.col(dy).cast("double") * F.col(dy).cast("double")
    rows = residuals.withColumn("_s", square).filter(F.col("_s").isNotNull() & ~F.isnan("_s"))
    return rows.groupBy(view).agg(F.count(F.lit(1)).alias("n"), (F.sqrt(F.sum("_s")) / F.count(F.lit(1))).alias("error"))


def greatest_view_error(residuals: DataFrame, view: str, dx: str, dy: str) -> DataFrame:
    """One row: views, and the greatest of their errors (null without views)."""
    return view_errors(residuals, view, dx, dy).agg(F.count(F.lit(1)).alias("n_views"), F.max("error").alias("greatest"))


def option_name(value: Column, option: str) -> Column:
    """The option's name as it is written, whatever the case of ``value``; unknown names and nulls are the default."""
    out = F.lit(OPTION_NAMES[option][0])
    for name in OPTION_NAMES[option]:
        out = F.when(F.lower(value) == name.lower(), F.lit(name)).otherwise(out)
    return out


def camera_model(matrix: Column, coefficients: Column, distortion: str) -> Column:
    """``fx, fy, cx, cy, radial, tangential`` of a 3x3 matrix (rows one after another) and a coefficient vector.

    A vector too short for its distortion gives no terms.
    """
    radial, tangential = DISTORTIONS[distortion]
    enough = F.size(coefficients) >= {0: 0, 1: 1}.get(len(radial), 5)

    def terms(places: tuple[int, ...]) -> Column:
        return F.when(enough, F.array(*[F.get(coefficients, F.lit(i)).cast("double") for i in places]).cast("array<double>")).otherwise(F.array().cast("array<double>"))

    fields = [F.get(matrix, F.lit(i)).cast("double").alias(n) for n, i in (("fx", 0), ("fy", 4), ("cx", 2), ("cy", 5))]
    return F.struct(*fields, terms(radial).alias("radial"), terms(tangential).alias("tangential"))


def calibration(camera: Column, distortion: str) -> tuple[Column, Column]:
    """Matrix and coefficient vector of a camera model; what the distortion has no term for is zero."""
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(camera["fx"], zero, camera["cx"], zero, camera["fy"], camera["cy"], zero, zero, one)
    radial, tangential = DISTORTIONS[distortion]
    places = {p: F.get(camera["radial"], F.lit(n)) for n, p in enumerate(radial)} | {p: F.get(camera["tangential"], F.lit(n)) for n, p in enumerate(tangential)}
    vector = F.array(*[F.coalesce(places.get(p, zero), zero) for p in range(max(places, default=-1) + 1)]).cast("array<double>")
    return matrix, vector


def from_keypoints(points: DataFrame, point: str) -> DataFrame:
    """Features from structs ``pt.x, pt.y, size, angle``; octave, response and class are left behind."""
    p = F.col(point)
    taken = [p["pt"]["x"].cast("double").alias("x"), p["pt"]["y"].cast("double").alias("y"), p["size"].cast("double").alias("size"), p["angle"].cast("double").alias("angle")]
    return points.select(*[c for c in points.columns if c != point], *taken)


def to_keypoints(features: DataFrame, point: str) -> DataFrame:
    """The structs of :func:`from_keypoints`, single precision; a null size is 0 and a null angle -1, as for none."""
    pt = F.struct(*[F.col(c).cast("float").alias(c) for c in "xy"]).alias("pt")
    value = F.struct(pt, F.coalesce(F.col("size"), F.lit(0.0)).cast("float").alias("size"), F.coalesce(F.col("angle"), F.lit(-1.0)).cast("float").alias("angle"))
    return features.select(*[c for c in features.columns if c not in ("x", "y", "size", "angle")], value.alias(point))


def from_index_matches(matches: DataFrame) -> DataFrame:
    """Matches from ``queryIdx, trainIdx, distance`` rows: no inliers until something finds them to be."""
    rest = [c for c in matches.columns if c not in ("queryIdx", "trainIdx", "distance")]
    return matches.select(*rest, F.col("queryIdx").cast("long").alias("feat_i"), F.col("trainIdx").cast("long").alias("feat_j"), F.lit(False).alias("is_inlier"))


def to_index_matches(matches: DataFrame) -> DataFrame:
    rest = [c for c in matches.columns if c not in ("feat_i", "feat_j", "is_inlier")]
    return matches.select(*rest, F.col("feat_i").cast("int").alias("queryIdx"), F.col("feat_j").cast("int").alias("trainIdx"), F.lit(0.0).cast("float").alias("distance"))


def normalise_observations(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    """Observations ``view_id, x, y, ...`` in camera coordinates ((x - cx) / fx, (y - cy) / fy), the pixels kept as ``x0, y0``.

    ``cameras``: view_id, fx, fy, cx, cy. Observations of a view without a camera, or one without focal lengths, have null places.
    """
    rows = observations.join(cameras.select("view_id", "fx", "fy", "cx", "cy"), "view_id", "left")
    places = [F.when(F.col(f) > 0, (F.col(v) - F.col(c)) / F.col(f)).alias(v) for v, f, c in (("x", "fx", "cx"), ("y", "fy", "cy"))]
    return rows.select(*[c for c in observations.columns if c not in ("x", "y", "x0", "y0")], *places, F.col("x").alias("x0"), F.col("y").alias("y0"))


def restore_observations(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    """Camera coordinates as pixels again, through the cameras."""
    rows = observations.join(cameras.select("view_id", "fx", "fy", "cx", "cy"), "view_id", "left")
    places = [(F.col(v) * F.col(f) + F.col(c)).alias(v) for v, f, c in (("x", "fx", "cx"), ("y", "fy", "cy"))]
    return rows.select(*[c for c in observations.columns if c not in ("x", "y")], *places)


def reset_observations(observations: DataFrame) -> DataFrame:
    """The pixels that were kept, where there are any."""
    places = [F.coalesce(f"{v}0", v).alias(v) for v in "xy"]
    return observations.select(*[c for c in observations.columns if c not in ("x", "y")], *places)


def point_errors(points: DataFrame, truth: DataFrame) -> DataFrame:
    """``point_id, error``: distance of each point from the true one; points of either side alone have no row."""
    a, b = (df.select("point_id", *[F.col(c).cast("double").alias(f"{c}{s}") for c in "xyz"]) for df, s in ((points, 1), (truth, 2)))
    square = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
    return a.join(b, "point_id").select("point_id", F.sqrt(square).alias("error"))


def match_totals(tried: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: pairs tried, pairs with matches, matches, pairs without any; of ``view_i, view_j`` pairs and their matches."""
    found = matches.groupBy("view_i", "view_j").agg(F.count(F.lit(1)).alias("n"))
    rows = tried.select("view_i", "view_j").distinct().join(found, ["view_i", "view_j"], "left")
    return rows.agg(
        F.count(F.lit(1)).alias("n_tried"), F.count("n").alias("n_matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches"), F.count_if(F.col("n").isNull()).alias("n_empty")
    )


def scene_match_totals(views: DataFrame, id_col: str, scene: str, matches: DataFrame) -> DataFrame:
    """What :func:`match_totals` gives for all pairs i < j of the views of each scene, which are counted and not listed.

    n views of a scene are n (n - 1) / 2 pairs; only pairs of views that stand in several scenes are listed, as a
    pair counts once.
    """
    placed = views.select(F.col(scene).alias("_s"), F.col(id_col).alias("view")).filter("_s IS NOT NULL AND view IS NOT NULL").distinct()
    tried = placed.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("tried"))
    several = placed.join(placed.groupBy("view").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("view"), "view", "left_semi")
    again = view_pairs(several, "view", "_s").groupBy("view_i", "view_j").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("again"))
    found = matches.filter("view_i < view_j").groupBy("view_i", "view_j").agg(F.count(F.lit(1)).alias("n"))
    a, b = (placed.select("_s", F.col("view").alias(f"view_{n}")) for n in "ij")
    matched = found.join(a, "view_i").join(b, ["_s", "view_j"]).select("view_i", "view_j", "n").distinct()
    rows = matched.agg(F.count(F.lit(1)).alias("n_matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches")).crossJoin(tried).crossJoin(again)
    n_tried = F.col("tried") - F.col("again")
    return rows.select(n_tried.alias("n_tried"), "n_matched", "n_matches", (n_tried - F.col("n_matched")).alias("n_empty"))


def track_points(observations: DataFrame) -> DataFrame:
    """``view_id, points``: of each view the features it has in tracks, as structs ``feature_id, track_id``, in order."""
    return observations.groupBy("view_id").agg(F.array_sort(F.collect_set(F.struct("feature_id", "track_id"))).alias("points"))


def only_used(rows: DataFrame, flag: str = "is_used", used: bool = True) -> DataFrame:
    """Rows that are used (or, with ``used`` false, those that are not); null is not used."""
    return rows.filter(F.coalesce(F.col(flag), F.lit(False)) == F.lit(used))


def sample_method(rows: DataFrame, value: str, offset: float) -> DataFrame:
    """The example of a method: every row with an offset added to a value."""
    return rows.withColumn(value, F.col(value) + F.lit(offset))
