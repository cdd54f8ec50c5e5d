"""Queries p3 (references to records that do not exist) and p5 (differences between two copies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.diff import Diff, Exact, Vector, diff_copies
from sightline.operators.references import Link, Orphans, Reference, Target, find_orphans
from sightline.operators.versions import current_rows
from sightline.runtime import table

IMAGE_FIELDS = (Exact("name"), Vector("qvec", sign_free=True), Vector("tvec"))


def _diff(spark: SparkSession, sf_dir: str) -> Diff:
    names = [f.name for f in IMAGE_FIELDS]
    sides = [current_rows(table(spark, sf_dir, t), "image_id", "added_at", names) for t in ("images", "model_images")]
    return diff_copies(*sides, "image_id", IMAGE_FIELDS, only_left="not_in_model_images", only_right="not_in_images")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).cells


def p5_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mismatched leaf ranges of keys and the rows of either copy in them."""
    return _diff(spark, sf_dir).ranges


def p5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).cells.groupBy("field").agg(F.count(F.lit(1)).alias("n_images"))


def references(spark: SparkSession, sf_dir: str) -> tuple[list[Reference], dict[str, Target]]:
    """The three referring fields and their two targets. Where a list names -1 or null it names nothing."""
    images = current_rows(table(spark, sf_dir, "images"), "image_id", "added_at", ["camera_id", "point2d_ids"])
    points = table(spark, sf_dir, "points3d").select("point_id", "track", "added_at")
    keypoints, cameras = table(spark, sf_dir, "keypoints"), table(spark, sf_dir, "cameras")
    cams = images.select("image_id", "camera_id", "added_at", F.lit(0).alias("pos"))
    kps = images.select("image_id", "added_at", F.posexplode("point2d_ids").alias("pos", "kp_id")).filter("kp_id <> -1")
    tracks = points.select("point_id", "added_at", F.posexplode("track").alias("pos", "e")).select(
        "point_id", "added_at", "pos", F.col("e.image_id").alias("image_id"), F.col("e.point2d_idx").alias("kp_idx")
    )
    refs = [
        Reference("images.camera_id", "images", "cameras", cams, "image_id", "pos", "added_at", ("camera_id",)),
        Reference("images.point2d_ids", "images", "keypoints", kps, "image_id", "pos", "added_at", ("kp_id",)),
        Reference("points3d.track", "points3d", "keypoints_by_place", tracks, "point_id", "pos", "added_at", ("image_id", "kp_idx")),
    ]
    targets = {
        "cameras": Target(cameras, ("camera_id",), "added_at", "removed_at"),
        "keypoints": Target(keypoints, ("kp_id",), "added_at", "removed_at"),
        "keypoints_by_place": Target(keypoints, ("image_id", "kp_idx"), "added_at", "removed_at"),
    }
    return refs, targets


def _orphans(spark: SparkSession, sf_dir: str) -> Orphans:
    """Keypoints depend on their image, descriptors on their keypoint, points and images on the keypoints they name."""
    refs, targets = references(spark, sf_dir)
    keypoints = table(spark, sf_dir, "keypoints").groupBy("kp_id", "image_id", "kp_idx").agg(F.min("added_at").alias("added_at"))
    on_point = refs[2].rows.join(keypoints.drop("added_at"), ["image_id", "kp_idx"]).select("point_id", "kp_id", "added_at")
    links = [
        Link("keypoints", "images", keypoints, "kp_id", "image_id", "added_at"),
        Link("descriptors", "keypoints", table(spark, sf_dir, "descriptors").select("kp_id", F.col("kp_id").alias("of_kp")), "kp_id", "of_kp"),
        Link("points3d", "keypoints", on_point, "point_id", "kp_id", "added_at"),
        Link("images", "keypoints", refs[1].rows, "image_id", "kp_id", "added_at"),
    ]
    return find_orphans(refs, targets, links)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).references.select("ref_field", "src_id", "pos", "reason").distinct()


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references of each referring field and month of the referring row (null: it has no time)."""
    month = F.date_format("at", "yyyy-MM")
    return _orphans(spark, sf_dir).references.groupBy("ref_field", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_refs"))


def p3_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records orphaned directly (they hold an orphan reference) or through a parent, with the month of their first row."""
    return _orphans(spark, sf_dir).records().select("tbl", "id", "kind", "depth", F.date_format("at", "yyyy-MM").alias("month"))


def p3_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_cascade(spark, sf_dir).groupBy("tbl", "month", "kind", "depth").agg(F.count(F.lit(1)).alias("n_records"))


QUERIES = {f.__name__: f for f in (p3_found, p3_counts, p3_cascade, p3_cascade_counts, p5_found, p5_ranges, p5_summary)}

_CURRENT = "(SELECT * FROM {t} WHERE image_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY added_at DESC NULLS LAST) = 1)"
_ELEMENT = "CASE WHEN a.x IS NULL OR b.x IS NULL THEN NOT (a.x IS NULL AND b.x IS NULL) WHEN isnan(a.x) OR isnan(b.x) THEN NOT (isnan(a.x) AND isnan(b.x)) ELSE abs(a.x - ({s} * b.x)) > 1e-6 END"


def _vector_sql(field: str, sign_free: bool) -> str:
    def unlike(sign: str) -> str:
        element = f"CASE WHEN l.{field}[i] IS NULL OR r.{field}[i] IS NULL THEN NOT (l.{field}[i] IS NULL AND r.{field}[i] IS NULL) WHEN isnan(l.{field}[i]) OR isnan(r.{field}[i]) THEN NOT (isnan(l.{field}[i]) AND isnan(r.{field}[i])) ELSE abs(l.{field}[i] - ({sign} * r.{field}[i])) > 1e-6 END"
        return f"coalesce(list_bool_or([{element} FOR i IN range(1, len(l.{field}) + 1)]), false)"

    both = f"{unlike('1')} AND {unlike('-1')}" if sign_free else unlike("1")
    return f"CASE WHEN l.{field} IS NULL OR r.{field} IS NULL THEN NOT (l.{field} IS NULL AND r.{field} IS NULL) WHEN len(l.{field}) <> len(r.{field}) THEN true ELSE {both} END"


P5_SQL = f"""
WITH l AS {_CURRENT.format(t="images")}, r AS {_CURRENT.format(t="model_images")}
SELECT image_id, 'not_in_images' AS field FROM r WHERE image_id NOT IN (SELECT image_id FROM l)
UNION ALL SELECT image_id, 'not_in_model_images' FROM l WHERE image_id NOT IN (SELECT image_id FROM r)
UNION ALL SELECT l.image_id, 'name' FROM l JOIN r USING (image_id) WHERE l.name IS DISTINCT FROM r.name
UNION ALL SELECT l.image_id, 'qvec' FROM l JOIN r USING (image_id) WHERE {_vector_sql("qvec", True)}
UNION ALL SELECT l.image_id, 'tvec' FROM l JOIN r USING (image_id) WHERE {_vector_sql("tvec", False)}
"""

_REFS_SQL = f"""
im AS {_CURRENT.format(t="images")},
refs AS (
  SELECT 'images.camera_id' AS ref_field, image_id AS src_id, 0 AS pos, added_at AS t, 'c' AS kind, camera_id::BIGINT AS a, 0::BIGINT AS b FROM im WHERE camera_id IS NOT NULL
  UNION ALL
  SELECT 'images.point2d_ids', image_id, i - 1, added_at, 'k', point2d_ids[i], 0 FROM im, LATERAL (SELECT unnest(range(1, len(point2d_ids) + 1)) AS i) WHERE point2d_ids[i] <> -1
  UNION ALL
  SELECT 'points3d.track', point_id, i - 1, added_at, 'p', track[i].image_id, track[i].point2d_idx
  FROM points3d, LATERAL (SELECT unnest(range(1, len(track) + 1)) AS i) WHERE track[i].image_id IS NOT NULL AND track[i].point2d_idx IS NOT NULL
),
rows_ AS (
  SELECT 'c' AS kind, camera_id::BIGINT AS a, 0::BIGINT AS b, added_at, removed_at FROM cameras
  UNION ALL SELECT 'k', kp_id, 0, added_at, removed_at FROM keypoints
  UNION ALL SELECT 'p', image_id, kp_idx, added_at, removed_at FROM keypoints
),
judged AS (
  SELECT ref_field, src_id, pos, t, count(r.kind) AS n, count(*) FILTER (r.added_at <= t AND (r.removed_at IS NULL OR r.removed_at > t)) AS n_live, count(*) FILTER (r.added_at > t) AS n_late
  FROM refs LEFT JOIN rows_ r USING (kind, a, b) GROUP BY ALL
),
orphans AS (
  SELECT DISTINCT ref_field, src_id, pos::INT AS pos, CASE WHEN n = 0 THEN 'missing' WHEN n_late = n THEN 'late' ELSE 'deleted' END AS reason, t FROM judged WHERE n_live = 0
)"""

CASCADE_LEVELS = 8  # more than the registered links can give


def _cascade_sql() -> str:
    """Levels of the cascade one after another, each without the records of those above."""
    parts = [_REFS_SQL, """
kps AS (SELECT kp_id, image_id, kp_idx::BIGINT AS kp_idx, min(added_at) AS at_ FROM keypoints GROUP BY ALL),
links AS (
  SELECT 'keypoints' AS tbl, kp_id AS id, at_, 'images' AS ptbl, image_id AS p FROM kps WHERE kp_id IS NOT NULL
  UNION ALL SELECT 'descriptors', kp_id, NULL, 'keypoints', kp_id FROM descriptors WHERE kp_id IS NOT NULL
  UNION ALL SELECT 'points3d', src_id, t, 'keypoints', kp_id FROM refs JOIN kps ON a = image_id AND b = kp_idx WHERE kind = 'p'
  UNION ALL SELECT 'images', src_id, t, 'keypoints', a FROM refs WHERE kind = 'k'
),
l0 AS (SELECT CASE WHEN ref_field LIKE 'images%' THEN 'images' ELSE 'points3d' END AS tbl, src_id AS id, 0 AS depth, min(t) AS at_ FROM orphans GROUP BY 1, 2), k0 AS (SELECT * FROM l0)"""]
    for n in range(1, CASCADE_LEVELS):
        parts.append(f"""l{n} AS (SELECT c.tbl, c.id, {n} AS depth, min(c.at_) AS at_ FROM links c JOIN l{n - 1} l ON l.tbl = c.ptbl AND l.id = c.p WHERE (c.tbl, c.id) NOT IN (SELECT tbl, id FROM k{n - 1}) GROUP BY 1, 2),
k{n} AS (SELECT * FROM k{n - 1} UNION ALL SELECT * FROM l{n})""")
    month = "strftime(at_ AT TIME ZONE 'UTC', '%Y-%m') AS month"
    return f"WITH {', '.join(p.strip() for p in parts)} SELECT tbl, id, CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END AS kind, depth::INT AS depth, {month} FROM k{CASCADE_LEVELS - 1}"


_SIDE = "SELECT floor(image_id / 64)::BIGINT AS leaf, {s} AS side, image_id FROM {t}"
P5_RANGES_SQL = f"""
WITH l AS {_CURRENT.format(t="images")}, r AS {_CURRENT.format(t="model_images")}, unequal AS (SELECT DISTINCT floor(image_id / 64)::BIGINT AS leaf FROM ({P5_SQL})),
n AS (SELECT leaf, count(*) FILTER (side = 'l') AS left_rows, count(*) FILTER (side = 'r') AS right_rows FROM ({_SIDE.format(s="'l'", t="l")} UNION ALL {_SIDE.format(s="'r'", t="r")}) GROUP BY leaf)
SELECT leaf * 64 AS first_key, leaf * 64 + 63 AS last_key, left_rows, right_rows FROM n JOIN unequal USING (leaf)
"""

SQL = {
    "p3_cascade": _cascade_sql(),
    "p3_cascade_counts": f"SELECT tbl, month, kind, depth, count(*)::BIGINT AS n_records FROM ({_cascade_sql()}) GROUP BY ALL",
    "p5_ranges": P5_RANGES_SQL,
    "p3_found": f"WITH {_REFS_SQL} SELECT DISTINCT ref_field, src_id, pos, reason FROM orphans",
    "p3_counts": f"WITH {_REFS_SQL} SELECT ref_field, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*)::BIGINT AS n_refs FROM orphans GROUP BY ALL",
    "p5_found": P5_SQL,
    "p5_summary": f"SELECT field, count(*)::BIGINT AS n_images FROM ({P5_SQL}) GROUP BY field",
}
