"""Text formats: features, matches, cameras, poses, scenes, models, point clouds.

Line formats are read as text and parsed by built-in functions; formats whose records span lines are read
file by file. Malformed lines are skipped, as stated at each reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.functions.parsing import base_name, dataset_name, strip_extension


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, line`` of text files."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", "\r$", "")).alias("line"))


def _files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, text`` of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("text"))


def read_images(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, name, dataset, length`` of the files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    above = F.regexp_replace("path", "/[^/]*$", "")
    return rows.select("path", base_name(F.col("path")).alias("name"), dataset_name(above).alias("dataset"), "length")


def list_datasets(spark: SparkSession, root: str) -> list[str]:
    """Folders ``root/*/images`` that exist, in order of their names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/images")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return sorted(s.getPath().toString() for s in (found or []) if s.isDirectory())


def read_feature_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, line_no, x, y, size, angle`` of ``x y [scale orientation]`` lines; lines without two numbers are skipped."""
    return _feature_lines(_files(spark, path))


FILES = 4_096  # files of views that one task reads


def write_feature_text(features: DataFrame, path: str) -> None:
    """A file of ``x y scale orientation`` lines for each view, ``view_id=<id>.txt`` in the folder, which is replaced.

    Tasks write the files of their views themselves: a file for each view is too many for a committer that moves
    them one by one, and a folder for each would take as much disk as the file. A file gets its name when it is whole,
    so a task that runs again does no harm. The lines of a view are one value, bounded by its features.
    """
    line = F.format_string("%.6f %.6f %.6f %.6f", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x", "y", "size", "angle")])
    lines = features.groupBy("view_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", line.alias("line")))).alias("lines"))
    rows = lines.select(F.col("view_id").cast("string").alias("view"), F.concat(F.array_join("lines.line", "\n"), F.lit("\n")).alias("text"))
    files, folder = pyarrow.fs.FileSystem.from_uri(path)
    if files.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
        files.delete_dir(folder)
    files.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        attempt = f"{folder}/.{uuid.uuid4().hex}"
        for batch in batches:
            for view, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_output_stream(attempt) as out:
                    out.write(text.encode())
                files.move(attempt, f"{folder}/view_id={'__HIVE_DEFAULT_PARTITION__' if view is None else view}.txt")
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def _feature_lines(rows: DataFrame) -> DataFrame:
    """``path, line_no, x, y, size, angle`` of ``path, text``."""
    lines = rows.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    part = F.split(F.trim("line"), r"\s+")
    n = [F.try_element_at(part, F.lit(i)).try_cast("double") for i in (1, 2, 3, 4)]
    return lines.select("path", "line_no", *[c.alias(name) for c, name in zip(n, ("x", "y", "size", "angle"), strict=True)]).filter("x IS NOT NULL AND y IS NOT NULL")


def read_feature_folder(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`read_feature_text` gives for ``<path>/*``, with ``view_id`` where the name has one: of any number of files.

    The driver holds no more than the names of the files; a task reads :data:`FILES` of them. Files whose names
    begin with a dot or an underscore are not read, as by Spark.
    """
    files, folder = pyarrow.fs.FileSystem.from_uri(path)
    names = sorted(f.base_name for f in files.get_file_info(pyarrow.fs.FileSelector(folder)) if f.is_file and f.base_name[0] not in "._")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                mine = names[k * FILES : (k + 1) * FILES]
                for s in range(0, len(mine), 64):
                    found, texts = [f"{folder}/{name}" for name in mine[s : s + 64]], []
                    for name in found:
                        with files.open_input_stream(name) as stream:
                            texts.append(stream.read().decode(errors="replace").replace("\r\n", "\n"))
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(texts, pa.string())], ["path", "text"])

    n = -(-len(names) // FILES)
    rows = spark.range(0, n, 1, max(1, n)).mapInArrow(read, "path string, text string")
    return _feature_lines(rows).withColumn("view_id", F.regexp_extract("path", "view_id=(-?[0-9]+)", 1).try_cast("long"))


MATCHES = "view_i long, view_j long, match_idx long, feat_i long, feat_j long, is_inlier boolean"


def parse_matches(text: str) -> list[tuple]:
    """Blocks ``I J n`` followed by n pairs; a block that ends early gives the pairs it has, all inliers."""
    out, tokens, at = [], [line.split() for line in text.splitlines() if line.strip()], 0
    while at < len(tokens):
        head = tokens[at]
        at += 1
        if len(head) < 3:
            continue
        i, j, n = int(head[0]), int(head[1]), int(head[2])
        for k, pair in enumerate(tokens[at : at + n]):
            if len(pair) >= 2:
                out.append((i, j, k, int(pair[0]), int(pair[1]), True))
        at += n
    return out


def read_match_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Matches of files with blocks of pairs."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for t in frame["text"] for r in parse_matches(t)]
            yield pd.DataFrame(rows, columns=["view_i", "view_j", "match_idx", "feat_i", "feat_j", "is_inlier"])

    return _files(spark, path).select("text").mapInPandas(parse, MATCHES)


def write_match_text(matches: DataFrame, path: str) -> None:
    """Blocks ``I J n`` and n pairs of features in the order of match_idx, what :func:`read_match_text` reads. A block is
    one value, so it stays whole; it is bounded by its images' features."""
    pairs = F.array_sort(F.collect_list(F.struct("match_idx", "feat_i", "feat_j")))
    rows = matches.groupBy("view_i", "view_j").agg(pairs.alias("m"))
    lines = F.transform("m", lambda p: F.concat_ws(" ", p["feat_i"].cast("string"), p["feat_j"].cast("string")))
    head = F.concat_ws(" ", F.col("view_i").cast("string"), F.col("view_j").cast("string"), F.size("m").cast("string"))
    rows.select(F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("value")).write.mode("overwrite").text(path)


def write_scene_json(views: DataFrame, poses: DataFrame, path: str, scene: str) -> None:
    """One scene file for each value of ``scene``: ``views`` (scene, view_id, name, width, height) and ``poses`` (scene,
    view_id, r, t, the centre). A scene file is one JSON value, bounded by its views."""
    data = F.struct(F.lit("").alias("local_path"), F.col("name").alias("filename"), F.col("width"), F.col("height"), F.col("view_id").alias("id_view"))
    listed = views.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct(F.col("view_id").alias("key"), F.struct(F.struct(data.alias("data")).alias("ptr_wrapper")).alias("value")))).alias("views"))
    rotation = F.array(*[F.slice("r", 3 * i + 1, 3) for i in range(3)])
    placed = poses.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct(F.col("view_id").alias("key"), F.struct(rotation.alias("rotation"), F.col("t").alias("center")).alias("value")))).alias("extrinsics"))
    value = F.to_json(F.struct(F.col(scene).alias("root_path"), "views", F.coalesce("extrinsics", F.array()).alias("extrinsics")))
    listed.join(placed, scene, "left").select(F.col(scene).alias("of"), value.alias("value")).repartition("of").write.mode("overwrite").partitionBy("of").text(path)


def read_match_folder(spark: SparkSession, folder: str, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches of files ``matches_<a>_<b>.txt`` (a header, then ``x1 y1 x2 y2``), and the files of unknown names.

    Names may hold underscores: the file name is compared with every pair of known names it can be split into.
    ``names``: name, view_id; a name stands for itself without its extension.
    """
    stem = strip_extension(base_name(F.regexp_replace("path", "%20", " ")))
    rows = _files(spark, f"{folder.rstrip('/')}/matches_*.txt").withColumn("stem", F.expr("substring(regexp_replace(regexp_replace(path, '^.*/', ''), '[.]txt$', ''), 9)"))
    known = names.select(strip_extension(F.col("name")).alias("stem"), "view_id")
    cuts = rows.select("path", "stem", F.explode(F.sequence(F.lit(1), F.greatest(F.length("stem") - 1, F.lit(1)))).alias("at")).filter(F.substring("stem", F.col("at"), F.lit(1)) == "_")
    split = cuts.select("path", F.substring("stem", F.lit(1), F.col("at") - 1).alias("a"), F.expr("substring(stem, at + 1)").alias("b"))
    a, b = known.select(F.col("stem").alias("a"), F.col("view_id").alias("view_i")), known.select(F.col("stem").alias("b"), F.col("view_id").alias("view_j"))
    pairs = split.join(a, "a").join(b, "b").select("path", "view_i", "view_j")
    lines = rows.join(pairs, "path").select("view_i", "view_j", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter("n > 0")
    part = F.split(F.trim("line"), r"\s+")
    numbers = [F.try_element_at(part, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"), 1)]
    del stem
    return lines.select("view_i", "view_j", (F.col("n") - 1).alias("match_idx"), *numbers).filter("y2 IS NOT NULL"), rows.join(pairs, "path", "left_anti").select("path")


def write_match_folder(located: DataFrame, path: str) -> None:
    """One folder for each pair of names with a line of both cameras, then the places of the matches."""
    head = located.groupBy("name_i", "name_j").agg(F.first("camera_i").alias("a"), F.first("camera_j").alias("b"))
    head = head.select("name_i", "name_j", F.lit(-1).cast("long").alias("n"), F.format_string("%d %d", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("value"))
    body = located.select("name_i", "name_j", F.col("match_idx").alias("n"), F.format_string("%.6f %.6f %.6f %.6f", "x1", "y1", "x2", "y2").alias("value"))
    rows = head.unionByName(body).repartition("name_i", "name_j").sortWithinPartitions("name_i", "name_j", "n")
    rows.select("name_i", "name_j", "value").write.mode("overwrite").partitionBy("name_i", "name_j").text(path)


def read_ground_truth(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``view_id, name, k, r, t`` of ``NNNN.jpg.camera`` files: 3 lines K, one of zeros, 3 lines R, one the centre.

    R is stored transposed in the file and is given as rotation from world to camera; files with fewer
    numbers or without a number for a name are skipped.
    """
    rows = _files(spark, path)
    name = F.regexp_extract("path", r"([^/]*)\.camera$", 1)
    values = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    rows = rows.select(name.alias("name"), F.regexp_extract("path", r"(\d+)[^/]*\.camera$", 1).try_cast("long").alias("view_id"), values.alias("v")).filter("view_id IS NOT NULL AND size(v) >= 24")
    kept = rows.filter(~F.exists(F.slice("v", 1, 24), lambda x: x.isNull()))
    return kept.select("view_id", "name", F.slice("v", 1, 9).alias("k"), g.transpose(F.slice("v", 13, 9)).alias("r"), F.slice("v", 22, 3).alias("t"))


def ground_truth_package(poses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Global poses (rotation and centre) and the relative poses of all their pairs i < j, for one scene."""
    a = poses.select(F.col("view_id").alias("view_i"), F.col("r").alias("ri"), F.col("t").alias("ti"))
    b = poses.select(F.col("view_id").alias("view_j"), F.col("r").alias("rj"), F.col("t").alias("tj"))
    rows = a.join(b, F.col("view_i") < F.col("view_j"))
    r, t = g.relative_pose(F.col("ri"), F.col("ti"), F.col("rj"), F.col("tj"))
    return poses, rows.select("view_i", "view_j", r.alias("r"), t.alias("t"))


def read_pose_text(spark: SparkSession, path: str | Sequence[str], names: DataFrame | None = None) -> DataFrame:
    """``name, r, t`` of lines ``name qw qx qy qz tx ty tz``; blank and ``#`` lines are skipped. With ``names``
    (name, view_id) also ``view_id``, unknown names being dropped."""
    part = F.split("line", r"\s+")
    n = [F.try_element_at(part, F.lit(i)).try_cast("double") for i in range(2, 9)]
    rows = _lines(spark, path).filter("line <> '' AND NOT startswith(line, '#')").select(F.element_at(part, 1).alias("name"), F.array(*n[:4]).alias("q"), F.array(*n[4:]).alias("t"))
    rows = rows.filter(~F.exists(F.concat("q", "t"), lambda x: x.isNull())).select("name", g.quaternion_to_rotation(F.col("q")).alias("r"), "t")
    return rows if names is None else rows.join(names.select("name", "view_id"), "name")


POSE_HEADER = ("image_id", "name", "camera_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "cx", "cy", "cz", "roll", "pitch", "yaw")


def pose_table(poses: DataFrame) -> DataFrame:
    """Camera poses with quaternion, translation, centre and Euler angles, from ``view_id, name, camera_id, r, t``."""
    rows = poses.withColumn("q", g.rotation_to_quaternion(F.col("r"))).withColumn("c", g.camera_centre(F.col("r"), F.col("t"))).withColumn("e", g.rotation_to_euler_zyx(F.col("r")))
    values = [F.col(v)[i] for v, n in (("q", 4), ("t", 3), ("c", 3), ("e", 3)) for i in range(n)]
    return rows.select(F.col("view_id").alias("image_id"), "name", "camera_id", *[v.alias(n) for v, n in zip(values, POSE_HEADER[3:], strict=True)])


def write_poses(poses: DataFrame, path: str, kind: str = "text") -> None:
    """Global poses as text (a line of the count, then name, R column by column, t, 8 decimals), csv or json."""
    if kind in ("csv", "json"):
        table = pose_table(poses)
        (table.coalesce(1).write.mode("overwrite").option("header", True).csv if kind == "csv" else table.coalesce(1).write.mode("overwrite").json)(path)
        return
    values = [F.format_string("%.8f", F.col("m")[i]) for i in range(9)] + [F.format_string("%.8f", F.col("t")[i]) for i in range(3)]
    rows = poses.withColumn("m", g.column_major(F.col("r")))
    body = rows.select(F.lit(1).alias("n"), F.col("name").alias("by"), F.concat_ws(" ", "name", *values).alias("value"))
    head = poses.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(0).alias("n"), F.lit("").alias("by"), "value")
    head.unionByName(body).coalesce(1).sortWithinPartitions("n", "by").select("value").write.mode("overwrite").text(path)


def read_global_pose_text(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_poses` writes as text: ``name, r, t``."""
    part = F.split("line", r"\s+")
    n = [F.try_element_at(part, F.lit(i)).try_cast("double") for i in range(2, 14)]
    rows = _lines(spark, path).select(F.element_at(part, 1).alias("name"), F.array(*n[:9]).alias("m"), F.array(*n[9:]).alias("t")).filter(n[11].isNotNull())
    return rows.select("name", g.transpose(F.col("m")).alias("r"), "t")


VIEWS = "root_path string, views array<struct<key:long,value:struct<ptr_wrapper:struct<data:struct<local_path:string,filename:string,width:int,height:int,id_view:long,id_intrinsic:long,id_pose:long>>>>>, extrinsics array<struct<key:long,value:struct<rotation:array<array<double>>,center:array<double>>>>"


def read_scene_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Views (``view_id, name, path, width, height``) and poses (``view_id, r, t``, t the centre) of a scene file.

    Poses without a rotation or a centre are skipped; of equal keys the last counts.
    """
    scene = _files(spark, path).select(F.from_json("text", VIEWS).alias("s"))
    views = scene.select("s.root_path", F.explode("s.views.value.ptr_wrapper.data").alias("d"))
    full = F.concat_ws("/", F.nullif(F.regexp_replace("root_path", "/+$", ""), F.lit("")), F.nullif("d.local_path", F.lit("")), "d.filename")
    found = views.select(F.col("d.id_view").alias("view_id"), F.col("d.filename").alias("name"), full.alias("path"), F.col("d.width").alias("width"), F.col("d.height").alias("height"))
    rows = scene.select(F.posexplode("s.extrinsics").alias("pos", "e")).filter("size(e.value.rotation) = 3 AND size(e.value.center) = 3")
    last = rows.groupBy(F.col("e.key").alias("view_id")).agg(F.max_by("e", "pos").alias("e"))
    return found, last.select("view_id", F.flatten("e.value.rotation").alias("r"), F.col("e.value.center").alias("t"))


def read_model_cameras(spark: SparkSession, path: str) -> DataFrame:
    """``camera_id, model, width, height, params`` of a model's camera lines."""
    part = F.split("line", r"\s+")
    rows = _lines(spark, path).filter("line <> '' AND NOT startswith(line, '#')")
    params = F.transform(F.slice(part, F.lit(5), F.greatest(F.size(part) - 4, F.lit(0))), lambda x: x.try_cast("double"))
    return rows.select(part[0].try_cast("int").alias("camera_id"), part[1].alias("model"), part[2].try_cast("int").alias("width"), part[3].try_cast("int").alias("height"), params.alias("params")).filter("camera_id IS NOT NULL")


MODEL_IMAGES = "image_id int, q array<double>, t array<double>, camera_id int, name string, points array<struct<x:double,y:double,point_id:long>>"


def parse_model_images(text: str) -> list[tuple]:
    """Records of two lines: id, q, t, camera, name; then x, y, point id of every point (none: an empty line)."""
    lines = [line for line in text.split("\n") if not line.startswith("#")]
    out, at = [], 0
    while at < len(lines):
        head = lines[at].split(None, 9)
        at += 1
        if len(head) < 10:
            continue
        points = lines[at].split() if at < len(lines) else []
        at += 1
        triples = [{"x": float(points[k]), "y": float(points[k + 1]), "point_id": int(points[k + 2])} for k in range(0, len(points) - 2, 3)]
        out.append((int(head[0]), [float(v) for v in head[1:5]], [float(v) for v in head[5:8]], int(head[8]), head[9].strip(), triples))
    return out


def read_model_images(spark: SparkSession, path: str) -> DataFrame:
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for t in frame["text"] for r in parse_model_images(t)], columns=["image_id", "q", "t", "camera_id", "name", "points"])

    return _files(spark, path).select("text").mapInPandas(parse, MODEL_IMAGES)


def read_model_points(spark: SparkSession, path: str) -> DataFrame:
    """``point_id, x, y, z, r, g, b, error, track`` of a model's point lines."""
    part = F.split("line", r"\s+")
    rows = _lines(spark, path).filter("line <> '' AND NOT startswith(line, '#')").filter(F.size(part) >= 8)
    n = (F.size(part) - 8) / 2
    track = F.when(n >= 1, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.struct(F.element_at(part, k * 2 + 9).cast("long").alias("image_id"), F.element_at(part, k * 2 + 10).cast("int").alias("point2d_idx"))))
    names = ("x", "y", "z")
    return rows.select(
        part[0].cast("long").alias("point_id"), *[part[i + 1].cast("double").alias(c) for i, c in enumerate(names)], *[part[i + 4].cast("int").alias(c) for i, c in enumerate("rgb")],
        part[7].cast("double").alias("error"), F.coalesce(track, F.array().cast("array<struct<image_id:bigint,point2d_idx:int>>")).alias("track"),
    )


def read_g2o(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (``view_id, t, q``) and edges (``view_i, view_j, t, q``, quaternions as w, x, y, z) of 3D poses."""
    part = F.split("line", r"\s+")
    rows = _lines(spark, path).select(part.alias("p"))

    def numbers(first: int):
        t = F.transform(F.slice("p", first, 3), lambda x: x.cast("double"))
        x, y, z, w = (F.element_at("p", first + 3 + i).cast("double") for i in range(4))
        return t.alias("t"), F.array(w, x, y, z).alias("q")

    vertices = rows.filter("p[0] = 'VERTEX_SE3:QUAT'").select(F.element_at("p", 2).cast("long").alias("view_id"), *numbers(3))
    edges = rows.filter("p[0] = 'EDGE_SE3:QUAT'").select(F.element_at("p", 2).cast("long").alias("view_i"), F.element_at("p", 3).cast("long").alias("view_j"), *numbers(4))
    return vertices, edges


def write_g2o(rel: DataFrame, path: str, poses: DataFrame | None = None) -> None:
    """Relative poses ``view_i, view_j, r, t`` as edges, and poses ``view_id, r, t`` as vertices."""

    def line(kind: str, ids: list[str], df: DataFrame) -> DataFrame:
        rows = df.withColumn("q", g.rotation_to_quaternion(F.col("r")))
        values = [F.format_string("%.9f", F.col(v)[i]) for v, order in (("t", (0, 1, 2)), ("q", (1, 2, 3, 0))) for i in order]
        return rows.select(F.concat_ws(" ", F.lit(kind), *[F.col(i).cast("string") for i in ids], *values, *([F.lit("1 0 0 0 0 0 1 0 0 0 0 1 0 0 0 1 0 0 1 0 1")] if len(ids) == 2 else [])).alias("value"))

    out = line("EDGE_SE3:QUAT", ["view_i", "view_j"], rel)
    if poses is not None:
        out = line("VERTEX_SE3:QUAT", ["view_id"], poses).unionByName(out)
    out.coalesce(1).write.mode("overwrite").text(path)


def write_ply(points: DataFrame, path: str, cameras: DataFrame | None = None) -> None:
    """Used points ``x, y, z, r, g, b`` as a point cloud, with camera centres in green if given; all points are written."""
    rows = points.filter(F.coalesce("is_used", F.lit(True))) if "is_used" in points.columns else points
    vertex = rows.select(*[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.coalesce(F.col(c).cast("int"), F.lit(255)).alias(c) for c in "rgb"])
    if cameras is not None:
        vertex = vertex.unionByName(cameras.select("x", "y", "z", F.lit(0).alias("r"), F.lit(255).alias("g"), F.lit(0).alias("b")))
    n = vertex.count()
    properties = [f"property float {c}" for c in "xyz"] + [f"property uchar {c}" for c in ("red", "green", "blue")]
    header = "\n".join(["ply", "format ascii 1.0", f"element vertex {n}", *properties, "end_header"])
    body = vertex.select(F.lit(1).alias("n"), F.format_string("%.6f %.6f %.6f %d %d %d", *list("xyzrgb")).alias("value"))
    head = points.sparkSession.createDataFrame([(0, header)], "n int, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)
