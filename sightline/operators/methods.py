"""The library's operators as registered methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import graph, matching, solvers
from sightline.operators import structure as st
from sightline.registry import register


def _evaluate_poses(found, truth):
    errors = st.pose_errors(found, truth)
    return errors.select("view_id", F.explode(F.create_map(*[x for m in ("rotation_error", "direction_error", "position_error") for x in (F.lit(m), F.col(m))])).alias("metric", "value"))


@register("match_features", ("features",), matcher="BF", ratio="0.8", cross_check="false")
def match_features(inputs, options):
    return matching.match_views(inputs["features"], options["matcher"], float(options["ratio"]), options["cross_check"] == "true")


@register("two_view_poses", ("bearings",), least_matches="50", threshold="0.005")
def two_view_poses(inputs, options):
    least = int(options["least_matches"])
    return solvers.two_view_poses(inputs["bearings"], least, least, threshold=float(options["threshold"]))


@register("matches_to_tracks", ("matches", "features"), drop_conflicts="false")
def matches_to_tracks(inputs, options):
    return graph.build_tracks(inputs["matches"], inputs["features"], options["drop_conflicts"] == "true")


@register("average_rotations", ("views", "relative"))
def average_rotations(inputs, options):
    return solvers.average_rotations(inputs["views"], inputs["relative"])


@register("image_poses", ("images",), evaluate=_evaluate_poses)
def image_poses(inputs, options):
    return st.poses(inputs["images"])
