"""Queries of descriptor matching (embeddings: the label is the view) and of view graphs and solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as g
from sightline.operators import graph, matching, solvers
from sightline.operators import structure as st
from sightline.plans.model import _FEATURES, _M, _P, _poses_sql, _rel_sql
from sightline.runtime import table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("view_id"), F.col("vec_id").alias("feature_id"), F.col("embedding").alias("vec"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("view_i", "view_j", "query", "target", F.round("distance", 6).alias("distance"))


def match_ratio_l2(spark, sf_dir):
    return _shown(matching.match_views(vectors(spark, sf_dir), "BF", ratio=0.97))


def match_ratio_l1(spark, sf_dir):
    return _shown(matching.match_views(vectors(spark, sf_dir), "BF_NORM_L1", ratio=0.97))


def match_hamming(spark, sf_dir):
    return _shown(matching.match_views(vectors(spark, sf_dir), "BF_HAMMING", ratio=0.97))


def match_nearest(spark, sf_dir):
    return _shown(matching.match_views(vectors(spark, sf_dir), "FLANN", ratio=None))


def match_knn_list(spark, sf_dir):
    return matching.nearest(vectors(spark, sf_dir), "l2", 3).select("view_i", "view_j", "query", "target", F.round("distance", 6).alias("distance"), "rank")


def match_mutual(spark, sf_dir):
    return _shown(matching.match_views(vectors(spark, sf_dir), "BF", ratio=None, cross_check=True))


def match_topn_per_pair(spark, sf_dir):
    return _shown(matching.match_views(vectors(spark, sf_dir), "BF", ratio=None, most=5))


def match_cascade_hash(spark, sf_dir):
    return _shown(matching.cascade_hash_matches(vectors(spark, sf_dir), ratio=None))


def match_pair_list(spark, sf_dir):
    """Matches of the pairs of a candidate list only: views one after another."""
    pairs = matching.view_pairs(vectors(spark, sf_dir)).filter("view_j = view_i + 1")
    return _shown(matching.match_views(vectors(spark, sf_dir), "BF", ratio=0.97, pairs=pairs))


def root_normalise(spark, sf_dir):
    rows = matching.rooted(vectors(spark, sf_dir))
    return rows.select("feature_id", F.posexplode("vec").alias("pos", "v")).select("feature_id", "pos", F.round("v", 6).alias("v"))


def zero_mean_descriptor(spark, sf_dir):
    return matching.zero_mean(vectors(spark, sf_dir)).select("pos", F.round("mean", 6).alias("mean"))


def pair_seeds(spark, sf_dir):
    pairs = table(spark, sf_dir, "matches").select("view_i", "view_j").distinct()
    return pairs.withColumn("seed", matching.pair_seed(F.col("view_i"), F.col("view_j")))


def weighted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View pairs with their number of inlier matches, whichever view comes first."""
    i, j = F.least("view_i", "view_j"), F.greatest("view_i", "view_j")
    m = table(spark, sf_dir, "matches").distinct().filter("is_inlier AND view_i <> view_j")
    return m.groupBy(i.alias("view_i"), j.alias("view_j")).agg(F.count(F.lit(1)).alias("weight"))


def view_graph_edges(spark, sf_dir):
    return graph.view_graph(weighted_pairs(spark, sf_dir))


def view_components(spark, sf_dir):
    return graph.components(weighted_pairs(spark, sf_dir), "view_i", "view_j")


def max_spanning_tree(spark, sf_dir):
    return graph.maximum_spanning_forest(weighted_pairs(spark, sf_dir)).withColumn("weight", F.col("weight").cast("long"))


def track_components(spark, sf_dir):
    features = st.features(table(spark, sf_dir, "keypoints"))
    tracks = graph.build_tracks(table(spark, sf_dir, "matches").distinct(), features)
    return tracks.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_features"), F.countDistinct("view_id").alias("n_views"))


def _relative_rotations(spark, sf_dir):
    return st.relative_poses(weighted_pairs(spark, sf_dir), st.poses(table(spark, sf_dir, "images"))).join(weighted_pairs(spark, sf_dir), ["view_i", "view_j"])


def rotation_propagation(spark, sf_dir):
    rel = _relative_rotations(spark, sf_dir)
    forest = graph.maximum_spanning_forest(rel.select("view_i", "view_j", "weight"))
    tree = forest.select("view_i", "view_j").join(rel.select("view_i", "view_j", "r"), ["view_i", "view_j"])
    views = st.poses(table(spark, sf_dir, "images")).select("view_id")
    return graph.propagate_rotations(views, tree).select("view_id", "depth", *[F.round(F.col("r")[k], 6).alias(f"r{k}") for k in range(9)])


def rotation_average(spark, sf_dir):
    views = st.poses(table(spark, sf_dir, "images"))
    found = solvers.average_rotations(views.select("view_id"), _relative_rotations(spark, sf_dir))
    return found.select("view_id", *[F.round(F.col("r")[k], 5).alias(f"r{k}") for k in range(9)])


def _centre_pairs(spark, sf_dir):
    def centres(t: str, s: str) -> DataFrame:
        p = st.poses(table(spark, sf_dir, t)).withColumn("c", g.camera_centre(F.col("r"), F.col("t")))
        return p.select("view_id", *([F.substring_index("name", "/", 1).alias("scene")] if s == "a" else []), *[F.col("c")[k].alias(f"{s}{k}") for k in range(3)])

    pairs = centres("model_images", "a").join(centres("images", "b"), "view_id").filter("scene IS NOT NULL")
    return pairs


def similarity_alignment(spark, sf_dir):
    """The sums that the alignment of each scene is solved from: the spread's logarithm, the cross-covariance as shares of it."""
    sums = solvers.alignment_sums(_centre_pairs(spark, sf_dir), ["scene"], ["a0", "a1", "a2"], ["b0", "b1", "b2"])
    some = F.when(F.col("spread") > 1e-6, F.col("spread"))
    return sums.select("scene", "n", (F.round(F.log10(some), 6) + F.lit(0.0)).alias("spread"), *[(F.round(F.col("cov")[k] / some, 6) + F.lit(0.0)).alias(f"h{k}") for k in range(9)])


def alignment_residual(spark, sf_dir):
    """Of each scene whether the alignment leaves less than translation alone, in closed form and by iteration alike."""
    pairs = _centre_pairs(spark, sf_dir)
    columns = [["a0", "a1", "a2"], ["b0", "b1", "b2"]]
    closed, iterated = (f(pairs, ["scene"], *columns) for f in (solvers.similarity_alignment, solvers.iterative_alignment))
    both = closed.filter("scale IS NOT NULL").join(iterated.select("scene", F.col("scale").alias("s2")), "scene")
    return both.select("scene", "n", (F.abs(F.col("scale") - F.col("s2")) <= 1e-3 * F.col("scale")).alias("alike"))


def residual_summary(spark, sf_dir):
    rel = _relative_rotations(spark, sf_dir)
    found = solvers.rotation_residuals(rel, st.poses(table(spark, sf_dir, "model_images")))
    return found.agg(F.count(F.lit(1)).alias("n"), *[F.round(f("residual"), 6).alias(n) for n, f in (("least", F.min), ("mean", F.avg), ("most", F.max))])


QUERIES = {
    f.__name__: f
    for f in (
        match_ratio_l2, match_ratio_l1, match_hamming, match_nearest, match_knn_list, match_mutual, match_topn_per_pair, match_cascade_hash, match_pair_list, root_normalise, zero_mean_descriptor, pair_seeds,
        view_graph_edges, view_components, max_spanning_tree, track_components, rotation_propagation, rotation_average, similarity_alignment, alignment_residual, residual_summary,
    )
}


def _near_sql(distance: str, backward: bool = False) -> str:
    q, t = ("b", "a") if backward else ("a", "b")
    return f"""(SELECT *, row_number() OVER (PARTITION BY view_i, view_j, query ORDER BY distance, target) AS rank, lead(distance) OVER (PARTITION BY view_i, view_j, query ORDER BY distance, target) AS second
      FROM (SELECT a.label::BIGINT AS view_i, b.label::BIGINT AS view_j, {q}.vec_id AS query, {t}.vec_id AS target, round({distance}, 12) AS distance FROM embeddings a JOIN embeddings b ON a.label < b.label))"""


_L2 = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_L1 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)))"
_HAMMING = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1.0 ELSE 0.0 END))"
_COLUMNS = "view_i, view_j, query, target, round(distance, 6) AS distance"
_PAIRS = "(SELECT least(view_i, view_j) AS view_i, greatest(view_i, view_j) AS view_j, count(*) AS weight FROM (SELECT DISTINCT * FROM matches) WHERE is_inlier AND view_i <> view_j GROUP BY 1, 2)"

_LINKS = f"(SELECT a.kp_id AS a, b.kp_id AS b FROM {_M} JOIN {_FEATURES} a ON a.view_id = view_i AND a.feature_id = feat_i JOIN {_FEATURES} b ON b.view_id = view_j AND b.feature_id = feat_j WHERE is_inlier AND a.kp_id <> b.kp_id)"
_OFF = " + ".join(f"(e.r{3 * i + j} - ({' + '.join(f'b.r{3 * i + k} * a.r{3 * j + k}' for k in range(3))})) * (e.r{3 * i + j} - ({' + '.join(f'b.r{3 * i + k} * a.r{3 * j + k}' for k in range(3))}))" for i in range(3) for j in range(3))


_POSED = f"(SELECT w.* FROM {_PAIRS} w JOIN {_P} a ON a.view_id = view_i JOIN {_P} b ON b.view_id = view_j)"
# relative rotations of one set of poses agree with each other, so from the root they are the poses' own
_FROM_ROOT = ", ".join(f"CASE WHEN d.depth IS NOT NULL THEN round({' + '.join(f'p.r{3 * i + k} * r.r{3 * j + k}' for k in range(3))}, 6) END AS r{3 * i + j}" for i in range(3) for j in range(3))


def _reached(links: str, a: str, b: str) -> str:
    """``reach``: every vertex with the least vertices that reached it so far, the least of all among them."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT {a} AS u, {b} AS v FROM {links} UNION SELECT {b}, {a} FROM {links}),
        reach(id, g) USING KEY (id) AS (SELECT u AS id, u AS g FROM (SELECT DISTINCT u FROM e)
          UNION SELECT n.id, n.g FROM (SELECT e.v AS id, min(r.g) AS g FROM reach r JOIN e ON e.u = r.id GROUP BY e.v) n JOIN recurring.reach c ON c.id = n.id WHERE n.g < c.g)"""


# Kruskal's test for each edge: it is in the forest unless heavier ones join its ends already. Heavier is by weight, then by the smaller pair.
_FOREST_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT view_i AS i, view_j AS j, weight, row_number() OVER (ORDER BY weight DESC, view_i, view_j) AS n FROM {pairs}),
    k(n, part, taken) AS (
      SELECT 0::BIGINT, map_from_entries(list((v, v))), false FROM (SELECT i AS v FROM e UNION SELECT j FROM e)
      UNION ALL
      SELECT e.n, CASE WHEN part[e.i] = part[e.j] THEN part ELSE map_from_entries(list_transform(map_entries(part), lambda p: CASE WHEN p.value = part[e.j] THEN (p.key, part[e.i]) ELSE (p.key, p.value) END)) END, part[e.i] <> part[e.j]
      FROM k JOIN e ON e.n = k.n + 1
    )
    SELECT i AS view_i, j AS view_j, weight FROM k JOIN e USING (n) WHERE taken"""

SQL = {
    "match_ratio_l2": f"SELECT {_COLUMNS} FROM {_near_sql(_L2)} WHERE rank = 1 AND distance < 0.97 * second",
    "match_pair_list": f"SELECT {_COLUMNS} FROM {_near_sql(_L2)} WHERE rank = 1 AND distance < 0.97 * second AND view_j = view_i + 1",
    "match_ratio_l1": f"SELECT {_COLUMNS} FROM {_near_sql(_L1)} WHERE rank = 1 AND distance < 0.97 * second",
    "match_hamming": f"SELECT {_COLUMNS} FROM {_near_sql(_HAMMING)} WHERE rank = 1 AND distance < 0.97 * second",
    "match_nearest": f"SELECT {_COLUMNS} FROM {_near_sql(_L2)} WHERE rank = 1",
    "match_knn_list": f"SELECT {_COLUMNS}, rank::INT AS rank FROM {_near_sql(_L2)} WHERE rank <= 3",
    "match_mutual": f"""SELECT {_COLUMNS.replace("view_i, view_j, query, target, round(distance", "f.view_i, f.view_j, f.query, f.target, round(f.distance")} FROM {_near_sql(_L2)} f JOIN {_near_sql(_L2, True)} b
        ON f.view_i = b.view_i AND f.view_j = b.view_j AND f.query = b.target AND f.target = b.query WHERE f.rank = 1 AND b.rank = 1""",
    "match_topn_per_pair": f"SELECT {_COLUMNS} FROM {_near_sql(_L2)} WHERE rank = 1 QUALIFY row_number() OVER (PARTITION BY view_i, view_j ORDER BY distance, query, target) <= 5",
    "root_normalise": """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), r AS (SELECT vec_id, pos, sqrt(abs(v) / (sum(abs(v)) OVER (PARTITION BY vec_id) + 1e-12)) AS s FROM e)
        SELECT vec_id AS feature_id, pos::INT AS pos, round(s / (sqrt(sum(s * s) OVER (PARTITION BY vec_id)) + 1e-12), 6) AS v FROM r""",
    "zero_mean_descriptor": "SELECT pos::INT AS pos, round(avg(v), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos",
    "pair_seeds": "SELECT DISTINCT view_i, view_j, xor(12345::BIGINT, (7919 * view_i + 7927 * view_j)::BIGINT) AS seed FROM matches",
    "view_graph_edges": f"SELECT view_i AS src, view_j AS dst, weight FROM {_PAIRS} UNION ALL SELECT view_j, view_i, weight FROM {_PAIRS}",
    "view_components": f"{_reached(_PAIRS, 'view_i', 'view_j')} SELECT id, min(g) AS component FROM reach GROUP BY id",
    "track_components": f"""{_reached(_LINKS, 'a', 'b')}, part AS (SELECT id, min(g) AS g FROM reach GROUP BY id)
        SELECT g AS track_id, count(*) AS n_features, count(DISTINCT view_id) AS n_views FROM part JOIN {_FEATURES} f ON f.kp_id = id GROUP BY g""",
    "max_spanning_tree": _FOREST_SQL.format(pairs=_PAIRS),
    "residual_summary": f"""SELECT count(*) AS n, round(min(d), 6) AS least, round(avg(d), 6) AS mean, round(max(d), 6) AS most FROM (SELECT sqrt({_OFF}) AS d FROM {_rel_sql('images', _PAIRS)} e
        JOIN {_poses_sql('model_images')} a ON a.view_id = e.view_i JOIN {_poses_sql('model_images')} b ON b.view_id = e.view_j)""",
    "similarity_alignment": f"""WITH p AS (SELECT split_part(a.name, '/', 1) AS scene, a.c0 AS a0, a.c1 AS a1, a.c2 AS a2, b.c0 AS b0, b.c1 AS b1, b.c2 AS b2 FROM {_poses_sql('model_images')} a JOIN {_P} b USING (view_id) WHERE a.name IS NOT NULL),
        m AS (SELECT *, a0 - avg(a0) OVER s AS x0, a1 - avg(a1) OVER s AS x1, a2 - avg(a2) OVER s AS x2, b0 - avg(b0) OVER s AS y0, b1 - avg(b1) OVER s AS y1, b2 - avg(b2) OVER s AS y2 FROM p WINDOW s AS (PARTITION BY scene))
        SELECT scene, n, round(log10(s), 6) + 0.0 AS spread, {", ".join(f"round(h{k} / s, 6) + 0.0 AS h{k}" for k in range(9))}
        FROM (SELECT *, CASE WHEN spread > 1e-6 THEN spread END AS s FROM (SELECT scene, count(*) AS n, sum(x0 * x0 + x1 * x1 + x2 * x2) AS spread, {", ".join(f"sum(y{i} * x{j}) AS h{3 * i + j}" for i in range(3) for j in range(3))} FROM m GROUP BY scene))""",
    "alignment_residual": f"""SELECT split_part(a.name, '/', 1) AS scene, count(*) AS n, true AS alike FROM {_poses_sql('model_images')} a JOIN {_P} b USING (view_id) WHERE a.name IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""",
    "rotation_propagation": f"""{_FOREST_SQL.format(pairs=_POSED).replace("SELECT i AS view_i, j AS view_j, weight FROM k", ", forest AS MATERIALIZED (SELECT i, j FROM k")}),
        t AS (SELECT i AS u, j AS v FROM forest UNION ALL SELECT j, i FROM forest), d(view_id, depth, above) AS (SELECT min(view_id), 0, NULL::BIGINT FROM {_P} UNION ALL SELECT t.v, depth + 1, view_id FROM d JOIN t ON t.u = d.view_id WHERE t.v IS DISTINCT FROM above)
        SELECT p.view_id, d.depth::INT AS depth, {_FROM_ROOT} FROM {_P} p LEFT JOIN d USING (view_id), (SELECT * FROM {_P} ORDER BY view_id LIMIT 1) r""",
    "rotation_average": f"""{_reached(_POSED, 'view_i', 'view_j')}, d AS (SELECT id AS view_id, 0 AS depth FROM (SELECT id, min(g) AS g FROM reach GROUP BY id) WHERE g = (SELECT min(view_id) FROM {_P}))
        SELECT p.view_id, {_FROM_ROOT.replace(", 6)", ", 5)")} FROM {_P} p LEFT JOIN d USING (view_id), (SELECT * FROM {_P} ORDER BY view_id LIMIT 1) r""",
}
