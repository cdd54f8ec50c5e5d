"""Binary formats: model files (little endian records) and feature databases in SQLite."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sightline.functions import geometry as g
from sightline.functions.parsing import PAIR_BASE, split_pair_id
from sightline.sources.text import MODEL_IMAGES, read_model_images

# Fixed values of the model format: the number of parameters of each camera model.
CAMERA_PARAMETERS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}


def parse_model_images(data: bytes) -> list[tuple]:
    """Images of a binary model: count; id, q, t, camera; name up to a zero; count of points; x, y, point id."""
    out, at = [], 8
    for _ in range(struct.unpack_from("<Q", data, 0)[0]):
        head = struct.unpack_from("<idddddddi", data, at)
        at += struct.calcsize("<idddddddi")
        end = data.index(b"\0", at)
        name = data[at:end].decode("utf-8", "replace")
        n = struct.unpack_from("<Q", data, end + 1)[0]
        at = end + 9
        records = np.frombuffer(data, np.dtype([("x", "<f8"), ("y", "<f8"), ("point_id", "<i8")]), n, at)
        at += records.nbytes
        out.append((head[0], list(head[1:5]), list(head[5:8]), head[8], name, [{"x": float(r["x"]), "y": float(r["y"]), "point_id": int(r["point_id"])} for r in records]))
    return out


def read_model_images_binary(spark: SparkSession, path: str) -> DataFrame:
    """Images of ``images.bin``, as :func:`read_model_images` gives them; one task for each file."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(parse_model_images(content), columns=["image_id", "q", "t", "camera_id", "name", "points"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, MODEL_IMAGES)


def find_model(spark: SparkSession, base: str) -> tuple[str, str] | None:
    """Path and kind (``bin`` before ``txt``) of the images of a model in ``sparse/0``, ``sparse`` or the folder itself."""
    jvm = spark._jvm.org.apache.hadoop.fs
    for place in ("sparse/0", "sparse", "."):
        for kind in ("bin", "txt"):
            path = jvm.Path(f"{base.rstrip('/')}/{place}/images.{kind}")
            if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
                return path.toString(), kind
    return None


def read_model(spark: SparkSession, base: str) -> DataFrame:
    found = find_model(spark, base)
    if found is None:
        raise FileNotFoundError(f"no model below {base}")
    return (read_model_images_binary if found[1] == "bin" else read_model_images)(spark, found[0])


def model_poses(images: DataFrame) -> DataFrame:
    """``name, r, t`` of a model's images; its quaternions are taken as unit quaternions."""
    return images.select("name", g.quaternion_to_rotation(F.col("q"), normalise=False).alias("r"), "t")


def write_model_binary(path: str, cameras: DataFrame, images: DataFrame, points: DataFrame, most: int = 50_000_000) -> None:
    """``cameras.bin``, ``images.bin`` and ``points3D.bin`` in a folder.

    The format is one file with its count in front, so rows are streamed through the driver partition by
    partition in order of their ids; models of more than ``most`` rows of a table are refused.
    """
    import os

    os.makedirs(path, exist_ok=True)

    def rows(df: DataFrame, key: str):
        n = df.count()
        if n > most:
            raise ValueError(f"{n} rows do not fit a model file")
        return n, df.orderBy(key).toLocalIterator(prefetchPartitions=True)

    with open(f"{path}/cameras.bin", "wb") as f:
        n, it = rows(cameras, "camera_id")
        f.write(struct.pack("<Q", n))
        for r in it:
            f.write(struct.pack("<iiQQ", r["camera_id"], r["model"], r["width"], r["height"]) + np.array(r["params"], "<f8").tobytes())
    with open(f"{path}/images.bin", "wb") as f:
        n, it = rows(images, "image_id")
        f.write(struct.pack("<Q", n))
        for r in it:
            f.write(struct.pack("<idddddddi", r["image_id"], *r["q"], *r["t"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(r["points"] or [])))
            for p in r["points"] or []:
                f.write(struct.pack("<ddq", p["x"], p["y"], p["point_id"]))
    with open(f"{path}/points3D.bin", "wb") as f:
        n, it = rows(points, "point_id")
        f.write(struct.pack("<Q", n))
        for r in it:
            track = r["track"] or []
            f.write(struct.pack("<QdddBBBdQ", r["point_id"], r["x"], r["y"], r["z"], r["r"], r["g"], r["b"], r["error"], len(track)))
            for e in track:
                f.write(struct.pack("<ii", e["image_id"], e["point2d_idx"]))


def export_model(poses: DataFrame, features: DataFrame, observations: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and points of a model from ``poses`` (view_id, name, camera_id, r, t), features, observations and points.

    Each image lists its features in order with the used point each stands in, or -1. Points keep all used
    observations; a track without one has an empty track.
    """
    used = observations.filter("is_used")
    seen = features.join(used.select("view_id", "feature_id", F.col("track_id").alias("point_id")), ["view_id", "feature_id"], "left")
    seen = seen.groupBy("view_id", "feature_id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max("point_id").alias("point_id"))
    lists = seen.groupBy("view_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "x", "y", F.coalesce("point_id", F.lit(-1)).alias("point_id")))).alias("l"))
    images = poses.join(lists, "view_id", "left").select(
        F.col("view_id").cast("int").alias("image_id"), g.rotation_to_quaternion(F.col("r")).alias("q"), "t", F.coalesce("camera_id", F.lit(0)).cast("int").alias("camera_id"), "name",
        F.coalesce(F.transform("l", lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"), e["point_id"].alias("point_id"))), F.array().cast("array<struct<x:double,y:double,point_id:bigint>>")).alias("points"),
    )
    tracks = used.groupBy("track_id").agg(F.array_sort(F.collect_set(F.struct(F.col("view_id").cast("int").alias("image_id"), F.col("feature_id").cast("int").alias("point2d_idx")))).alias("track"))
    empty = F.array().cast("array<struct<image_id:int,point2d_idx:int>>")
    out = points.join(tracks, points["point_id"] == tracks["track_id"], "left").select(
        "point_id", "x", "y", "z", *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in "rgb"], F.coalesce(F.nanvl("error", F.lit(0.0)), F.lit(0.0)).alias("error"), F.coalesce("track", empty).alias("track")
    )
    return images, out


# Tables of a feature database, their columns and the element type of their blobs.
DATABASE_TABLES = {
    "cameras": ("camera_id int, model int, width int, height int, params array<double>", "SELECT camera_id, model, width, height, params FROM cameras"),
    "images": ("image_id bigint, name string, camera_id int", "SELECT image_id, name, camera_id FROM images"),
    "keypoints": ("image_id bigint, rows int, cols int, data array<float>", "SELECT image_id, rows, cols, data FROM keypoints WHERE rows > 0"),
    "descriptors": ("image_id bigint, rows int, cols int, data array<smallint>", "SELECT image_id, rows, cols, data FROM descriptors WHERE rows > 0"),
    "matches": ("pair_id bigint, rows int, cols int, data array<bigint>", "SELECT pair_id, rows, cols, data FROM matches WHERE rows > 0"),
    "poses": (
        "image_id bigint, name string, camera_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double",
        "SELECT image_id, name, camera_id, qw, qx, qy, qz, tx, ty, tz FROM (SELECT image_id, name, camera_id, {columns} FROM images)",
    ),
    "camera_poses": (
        "image_id bigint, name string, camera_id int, model int, width int, height int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, "
        "prior_qw double, prior_qx double, prior_qy double, prior_qz double, prior_tx double, prior_ty double, prior_tz double, params array<double>",
        "SELECT i.image_id, i.name, i.camera_id, c.model, c.width, c.height, {columns}, c.params FROM images i LEFT JOIN cameras c ON c.camera_id = i.camera_id",
    ),
    "points3D": ("point3D_id bigint, x double, y double, z double, r int, g int, b int, error double", "SELECT point3D_id, x, y, z, r, g, b, error FROM points3D"),
}
KEYS = {"matches": "pair_id", "cameras": "camera_id", "points3D": "point3D_id"}  # of the others image_id
POSE_COLUMNS = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
BLOBS = {"cameras": "<f8", "camera_poses": "<f8", "keypoints": "<f4", "descriptors": "u1", "matches": "<u4"}


class _Part(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int):
        self.path, self.table, self.parts = path, table, parts

    def partitions(self) -> list[_Part]:
        key = KEYS.get(self.table, "image_id")
        source = "images" if self.table.endswith("poses") else self.table
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min({key}), max({key}) FROM {source}").fetchone()
        if low is None:
            return [_Part(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Part(s, min(s + step - 1, high)) for s in range(low, high + 1, step)]

    def read(self, part: _Part) -> Iterator[tuple]:
        key = KEYS.get(self.table, "image_id")
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            sql = DATABASE_TABLES[self.table][1]
            names = POSE_COLUMNS
            there = {r[1] for r in con.execute("PRAGMA table_info(images)")} if self.table.endswith("poses") else set()
            sides = [[f"{p}{n}" if f"{p}{n}" in there else "NULL" for n in names] for p in ("", "prior_")]
            if self.table == "camera_poses":
                sql = sql.format(columns=", ".join(f"{c} AS {p}{n}" for p, side in zip(("", "prior_"), sides, strict=True) for c, n in zip(side, names, strict=True)))
            if self.table == "poses":
                chosen = [f"CASE WHEN {sides[0][0]} IS NOT NULL THEN {a} ELSE {b} END" for a, b in zip(*sides, strict=True)]
                sql = sql.format(columns=", ".join(f"{c} AS {n}" if n[0] == "q" else f"coalesce({c}, 0) AS {n}" for c, n in zip(chosen, names, strict=True))) + " WHERE qw IS NOT NULL"
            sql = f"SELECT * FROM ({sql}) WHERE {key} BETWEEN ? AND ?"
            for row in con.execute(sql, (part.low, part.high)):
                if self.table in BLOBS and row[-1] is not None:
                    row = (*row[:-1], np.frombuffer(row[-1], BLOBS[self.table]).tolist())
                yield row


class FeatureDatabase(DataSource):
    """``spark.read.format("feature_database").option("path", file).option("table", name)``.

    Tables: cameras, images, keypoints, descriptors, matches, points3D, poses (optimised pose where there is one,
    else the prior; null translations are zero; images without either are left out) and camera_poses (every
    image with its camera and both poses side by side). Ranges of the key are read
    in parallel (option ``parts``). The file must be readable where the tasks run.
    """

    @classmethod
    def name(cls) -> str:
        return "feature_database"

    def schema(self) -> str:
        return DATABASE_TABLES[self.options["table"]][0]

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options["table"], int(self.options.get("parts", "8")))


def read_database(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a feature database; keypoints, descriptors and matches as one row for each feature or match."""
    spark.dataSource.register(FeatureDatabase)
    raw = spark.read.format("feature_database").option("path", path).option("table", table).load()
    if table not in ("keypoints", "descriptors", "matches"):
        return raw
    rows = raw.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("n"))
    at = F.col("n") * F.col("cols")
    if table == "matches":
        first, second = split_pair_id(F.col("pair_id"))
        return rows.select(first.alias("view_i"), second.alias("view_j"), F.col("n").cast("long").alias("match_idx"), F.get("data", at).alias("feat_i"), F.get("data", at + 1).alias("feat_j"), F.lit(True).alias("is_inlier"))
    if table == "descriptors":
        return rows.select("image_id", F.col("n").alias("kp_idx"), F.slice("data", at + 1, F.col("cols")).alias("descriptor"))
    return rows.select("image_id", F.col("n").alias("kp_idx"), F.get("data", at).alias("x"), F.get("data", at + 1).alias("y"))


def write_database(path: str, cameras: DataFrame, images: DataFrame, keypoints: DataFrame, matches: DataFrame, most: int = 50_000_000) -> None:
    """A feature database with tables cameras, images (with poses), keypoints and matches in one SQLite file.

    One file has one writer, so blobs are packed where the rows are, one for each image or pair, and streamed
    through the driver; tables of more than ``most`` blobs or rows are refused. Keypoints are numbered by their
    index, and matches refer to it; matches of unordered pairs are stored with the smaller view first.
    """
    import os

    def packed(rows: DataFrame, keys: list[str], order: str, values: list[str], kind: str) -> DataFrame:
        grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("l"))

        @F.pandas_udf("binary")
        def blob(lists: pd.Series) -> pd.Series:
            return lists.map(lambda rs: np.array([[r[v] for v in values] for r in rs], kind).tobytes())

        return grouped.select(*keys, F.size("l").alias("n"), blob("l").alias("data"))

    def rows(df: DataFrame, key: str):
        n = df.count()
        if n > most:
            raise ValueError(f"{n} rows do not fit a database file")
        return df.orderBy(key).toLocalIterator(prefetchPartitions=True)

    if os.path.exists(path):
        os.remove(path)
    first, second = F.least("view_i", "view_j"), F.greatest("view_i", "view_j")
    turned = F.col("view_i") > F.col("view_j")
    pairs = matches.filter("view_i <> view_j").select(
        (first * PAIR_BASE + second).alias("pair_id"), "match_idx", F.when(turned, F.col("feat_j")).otherwise(F.col("feat_i")).alias("a"), F.when(turned, F.col("feat_i")).otherwise(F.col("feat_j")).alias("b")
    )
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE cameras (camera_id INTEGER PRIMARY KEY, model INTEGER, width INTEGER, height INTEGER, params BLOB)")
        con.executemany("INSERT INTO cameras VALUES (?, ?, ?, ?, ?)", ((r["camera_id"], r["model"], r["width"], r["height"], np.array(r["params"] or [], "<f8").tobytes()) for r in rows(cameras, "camera_id")))
        con.execute(f"CREATE TABLE images (image_id INTEGER PRIMARY KEY, name TEXT, camera_id INTEGER, {', '.join(f'{c} REAL' for c in POSE_COLUMNS)})")
        con.executemany("INSERT INTO images VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", ((r["image_id"], r["name"], r["camera_id"], *(r["q"] or [None] * 4), *(r["t"] or [None] * 3)) for r in rows(images, "image_id")))
        for name, key, df, columns in (("keypoints", "image_id", packed(keypoints, ["image_id"], "kp_idx", ["x", "y"], "<f4"), 2), ("matches", "pair_id", packed(pairs, ["pair_id"], "match_idx", ["a", "b"], "<u4"), 2)):
            con.execute(f"CREATE TABLE {name} ({key} INTEGER PRIMARY KEY, rows INTEGER, cols INTEGER, data BLOB)")
            con.executemany(f"INSERT INTO {name} VALUES (?, ?, {columns}, ?)", ((r[key], r["n"], bytes(r["data"])) for r in rows(df, key)))


assert PAIR_BASE == 2**31 - 1
