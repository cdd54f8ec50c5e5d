"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.clusters import cluster_members, describe_clusters, similarity_clusters
from sightline.llm.components import connected_components, keypoint_links
from sightline.llm.leakage import find_leaks
from sightline.llm.neighbours import similar_vectors
from sightline.llm.subjects import assign_subjects
from sightline.llm.tokenizer import decode_corpus, encode_corpus
from sightline.runtime import table

TOKENIZER_DIR = os.environ.get("SIGHTLINE_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(table(spark, sf_dir, "descriptors").select("kp_id", "descriptor"), "kp_id", "descriptor", k=5, max_distance=120.0)
    return near.select(F.least("id", "neighbour").alias("kp_a"), F.greatest("id", "neighbour").alias("kp_b")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = keypoint_links(*(table(spark, sf_dir, t) for t in ("keypoints", "matches", "points3d")))
    return connected_components(links).select(F.col("id").alias("kp_id"), "group_id")


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p2_found(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_clusters(table(spark, sf_dir, "descriptors").select("kp_id", "descriptor"), "kp_id", "descriptor")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = cluster_members(table(spark, sf_dir, "descriptors").select("kp_id", "descriptor"), "kp_id", "descriptor")
    return members.select(F.col("id").alias("kp_id"), "cluster_id")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size, its parts and its most typical keypoints."""
    return describe_clusters(_clusters(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), f"{TOKENIZER_DIR}/byte_bpe_50k.json")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's ids decode to its text again, and how many ids it has."""
    path, docs = f"{TOKENIZER_DIR}/byte_bpe_50k.json", table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode_corpus(docs, path)
    back = decode_corpus(ids, path).withColumnRenamed("text", "back")
    same = F.coalesce("text", F.lit("")) == F.col("back")
    return docs.join(back, "doc_id").select("doc_id", same.alias("same"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_passages(spark, sf_dir).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item of each document with the place and length of its longest stretch."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_subjects(*(table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each area, and their share of all documents."""
    total = table(spark, sf_dir, "documents").count()
    sizes = p8_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"))
    return sizes.select("subject", "n_documents", F.round(F.col("n_documents") / F.lit(max(total, 1)), 6).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_sizes, p4_found, p4_clusters, p6_ids, p6_roundtrip, p7_found, p7_passages, p8_found, p8_shares)}

_AT = "(SELECT image_id, kp_idx::BIGINT AS kp_idx, min(kp_id) AS kp FROM keypoints WHERE kp_id IS NOT NULL GROUP BY ALL)"
_LINKS = f"""(SELECT a.kp AS u, b.kp AS v FROM matches JOIN {_AT} a ON a.image_id = view_i AND a.kp_idx = feat_i JOIN {_AT} b ON b.image_id = view_j AND b.kp_idx = feat_j WHERE is_inlier AND a.kp <> b.kp
  UNION SELECT min(kp) OVER (PARTITION BY n), kp FROM (SELECT n, e.image_id AS image_id, e.point2d_idx::BIGINT AS kp_idx FROM (SELECT n, unnest(track) AS e FROM (SELECT row_number() OVER () AS n, track FROM points3d WHERE is_used)))
    JOIN {_AT} USING (image_id, kp_idx))"""
_NEAR = """(WITH x AS MATERIALIZED (SELECT DISTINCT kp_id, descriptor::FLOAT[128] AS d FROM descriptors WHERE kp_id IS NOT NULL AND len(descriptor) = 128 AND len(list_filter(descriptor, lambda v: v IS NULL OR v < 0 OR v > 255)) = 0 AND list_max(descriptor) > 0)
  SELECT a.kp_id AS u, b.kp_id AS v FROM x a JOIN x b ON a.kp_id < b.kp_id WHERE array_distance(a.d, b.d) <= 240.0001)"""


def _groups_sql(links: str) -> str:
    """``id, g``: every vertex with the least one it is linked to, directly or through others."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT u, v FROM {links} WHERE u <> v UNION SELECT v, u FROM {links} WHERE u <> v),
      reach(id, g) USING KEY (id) AS (SELECT u AS id, u AS g FROM (SELECT DISTINCT u FROM e)
        UNION SELECT n.id, n.g FROM (SELECT e.v AS id, min(r.g) AS g FROM reach r JOIN e ON e.u = r.id GROUP BY e.v) n JOIN recurring.reach c ON c.id = n.id WHERE n.g < c.g)
      SELECT id, min(g) AS g FROM reach GROUP BY id"""


SQL: dict[str, str] = {
    "p2_found": f"SELECT id AS kp_id, g AS group_id FROM ({_groups_sql(_LINKS)})",
    "p2_sizes": f"SELECT size, count(*) AS n_groups FROM (SELECT g, count(*) AS size FROM ({_groups_sql(_LINKS)}) GROUP BY g) GROUP BY size",
    "p4_found": f"SELECT id AS kp_id, g AS cluster_id FROM ({_groups_sql(_NEAR)}) QUALIFY count(*) OVER (PARTITION BY g) >= 8",
    "p6_roundtrip": "SELECT doc_id, true AS same FROM documents",
}
