"""Core operators against known truths, brute force and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import arrays, parsing
from sightline.functions import geometry as g
from sightline.operators import evaluation as ev
from sightline.operators import graph, matching, profiling, robust, selection, solvers
from sightline.operators import structure as st
from sightline.operators.diff import Exact, Vector, diff_copies
from sightline.operators.references import Link, Reference, Target, orphan_cascade, orphan_references
from sightline.operators.versions import current_rows

NAN = float("nan")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_rotations(n, seed=0):
    return solvers._exp(np.random.RandomState(seed).normal(size=(n, 3)))


@pytest.fixture(scope="module")
def rotations(spark):
    r = random_rotations(20, 3)
    return spark.createDataFrame([(i, m.ravel().tolist(), [float(i), 1.0, 2.0]) for i, m in enumerate(r)], "view_id long, r array<double>, t array<double>")


def test_rotation_round_trips(rotations):
    r = F.col("r")
    out = rotations.select(
        g.frobenius(g.quaternion_to_rotation(g.rotation_to_quaternion(r)), r), g.frobenius(g.angle_axis_to_rotation(g.rotation_to_angle_axis(r)), r),
        g.frobenius(g.euler_zyx_to_rotation(g.rotation_to_euler_zyx(r)), r), g.frobenius(g.cayley_to_rotation(g.rotation_to_cayley(r)), r), F.abs(g.determinant(r) - 1),
        g.rotation_angle(r, r), g.distance(g.camera_centre(r, g.to_world_translation(r, F.col("t"))), F.col("t")),
    )
    assert np.abs(np.array(out.collect(), float)).max() < 1e-5


def test_half_turn_and_zero_vector(spark):
    df = spark.createDataFrame([([1.0, 0, 0, 0, -1, 0, 0, 0, -1], [0.0, 0, 0])], "r array<double>, t array<double>")
    q, direction, inverse = df.select(g.rotation_to_quaternion(F.col("r")), g.direction_angle(F.col("t"), F.col("t")), g.frobenius(g.angle_axis_to_rotation(g.rotation_to_angle_axis(F.col("r"))), F.col("r"))).first()
    assert q == [0.0, 1.0, 0.0, 0.0] and direction is None and inverse < 1e-9


def test_pose_formats_and_relative(rotations):
    for source in g.POSE_FORMATS:
        for target in g.POSE_FORMATS:
            r, t = g.convert_pose(F.col("r"), F.col("t"), source, target)
            r, t = g.convert_pose(r, t, target, source)
            assert rotations.select(F.max(g.distance(t, F.col("t"))) + F.max(g.frobenius(r, F.col("r")))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        g.convert_pose(F.col("r"), F.col("t"), "x", "RwTw")


def test_array_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0, 0.0], [0.0, 0.0, 0.0]), ([1.0, -1.0, 2.0], [1.0, 1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(arrays.l2_distance(F.col("a"), F.col("b"))).collect()] == [5.0, 2.0]
    assert [r[0] for r in df.select(arrays.l1_distance(F.col("a"), F.col("b"))).collect()] == [7.0, 2.0]
    assert df.select(arrays.hamming_distance(arrays.sign_bits(F.col("a"), 3), arrays.sign_bits(F.col("b"), 3))).collect()[1][0] == 1
    rooted = np.array(df.select(arrays.root_normalise(F.col("a"))).first()[0])
    want = np.sqrt(np.array([3, 4, 0]) / 7)
    assert np.allclose(rooted, want / np.linalg.norm(want))
    assert df.select(arrays.upper_median(F.array(F.lit(4.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)))).first()[0] == 3.0


def test_parsing(spark):
    df = spark.createDataFrame([(" 7 ", "Yes", "a_12"), ("x", "nope", "plain"), (None, None, None)], "n string, b string, c string")
    assert [r[0] for r in df.select(parsing.option(F.col("n"), "int", -1)).collect()] == [7, -1, -1]
    assert [r[0] for r in df.select(parsing.option_bool(F.col("b"), False)).collect()] == [True, False, False]
    assert rows(df.select(*parsing.smart_commit(F.col("c")))) == rows(spark.createDataFrame([("a", 12.0), (None, None), (None, None)], "a string, b double"))
    pair = spark.range(1).select(parsing.pair_id(F.lit(9), F.lit(2)).alias("p"))
    assert pair.select(*parsing.split_pair_id(F.col("p"))).first() == (2, 9)
    assert parsing.expand_placeholders("{a}/x/{no}", {"a": "{b}", "b": "root"}) == "root/x/{no}"
    ini = parsing.read_ini("[m]\n@inherit=base\nk=2 # note\n", lambda name: "[m]\nk=1\nother=5\n")
    assert ini == {"m": {"k": "2", "other": "5"}}
    assert parsing.resolve_options({"k": "0", "z": "1"}, {"k": "1"}, {"k": "2"}) == {"k": "2", "z": "1"}
    assert spark.range(1).select(parsing.dataset_name(F.lit("/d/castle/images/")), parsing.dataset_name(F.lit("/d/other"))).first() == ("castle", "other")
    assert spark.range(1).select(parsing.parse_intrinsics(F.lit("1,2;3")), F.size(parsing.parse_intrinsics(F.lit("1,2,3;4,5,6,7,8,9")))).first() == (None, 9)


def test_current_rows(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (1, 9, "new"), (2, None, "only"), (None, 1, "lost")], "k long, v int, f string").withColumn("r", F.lit(0))
    assert rows(current_rows(df, "k", "v", ["f"])) == [(1, 9, "new"), (2, None, "only")]


FIELDS = [Exact("name"), Vector("q", sign_free=True), Vector("t")]
SIDE = "id long, name string, q array<double>, t array<double>, l int, extra string"


def side(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], SIDE)


def test_diff_finds_every_cell(spark):
    q, t = [0.5, -0.5, 0.5, 0.5], [1.0, 2.0, 3.0]
    left = [(i, f"n{i}", q, t) for i in range(300)] + [(900, None, None, None), (901, "a", [NAN] * 4, [None, 1.0])]
    right = [list(r) for r in left]
    right[3][1] = "N3"
    right[4][2] = [-x for x in q]
    right[5][2] = [0.5, 0.5, 0.5, 0.5]
    right[6][3] = [1.0, 2.0, 3.0 + 5e-7]
    right[7][3] = [1.0, 2.0, 3.0 + 2e-6]
    right[8][3] = None
    right[9][3] = [1.0, 2.0]
    right[-1][3] = [None, NAN]
    del right[10]
    right.append([-77, "z", q, t])
    out = diff_copies(side(spark, left), side(spark, [tuple(r) for r in right]), "id", FIELDS, leaf_width=8)
    assert rows(out.cells) == sorted([(3, "name"), (5, "q"), (7, "t"), (8, "t"), (9, "t"), (901, "t"), (10, "not_in_right"), (-77, "not_in_left")], key=str)
    assert out.ranges.count() < 12


def test_diff_of_equal_and_empty_sides(spark):
    a = side(spark, [(1, "n", [1.0, 0, 0, 0], [0.0] * 3)])
    empty = a.limit(0)
    assert diff_copies(a, a, "id", FIELDS).cells.isEmpty()
    assert diff_copies(empty, empty, "id", FIELDS).cells.isEmpty()
    assert rows(diff_copies(a, empty, "id", FIELDS).cells) == [(1, "not_in_right")]
    assert diff_copies(side(spark, [(None, "n", None, None)]), empty, "id", FIELDS).cells.isEmpty()


def test_orphan_references_and_cascade(spark):
    target = spark.createDataFrame([(1, 10, None), (1, 10, None), (2, 10, 20), (2, 30, None), (3, 50, None), (4, 10, 20), (None, 1, None)], "k int, added int, removed int")
    refs = spark.createDataFrame([(100 + i, 0, at, k) for i, (k, at) in enumerate([(1, 10), (2, 25), (2, 30), (3, 40), (4, 20), (4, 19), (9, 10), (None, 1), (1, None)])], "s long, pos int, at int, k int")
    ref = Reference("f", "o", "t", refs.unionByName(refs), "s", "pos", "at", ("k",))
    found = orphan_references([ref], {"t": Target(target, ("k",), "added", "removed")})
    assert rows(found.select("src_id", "reason")) == [(101, "deleted"), (103, "late"), (104, "deleted"), (106, "missing"), (108, "deleted")]
    empty = Reference("f", "o", "t", refs.limit(0), "s", "pos", "at", ("k",))
    assert orphan_references([empty], {"t": Target(target.limit(0), ("k",), "added", "removed")}).isEmpty()
    direct = spark.createDataFrame([("a", 1), ("a", 1), ("b", 5)], "tbl string, id long")
    child = spark.createDataFrame([(5, 1), (6, 1), (7, 2), (None, 1)], "c long, p long")
    loop = spark.createDataFrame([(1, 6)], "c long, p long")
    out = orphan_cascade(direct, [Link("b", "a", child, "c", "p"), Link("a", "b", loop, "c", "p")])
    assert rows(out) == [("a", 1, "direct", 0), ("b", 5, "direct", 0), ("b", 6, "inherited", 1)]
    assert orphan_cascade(direct.limit(0), [Link("b", "a", child, "c", "p")]).isEmpty()


def test_upper_median_and_x84(spark):
    values = [(i % 3, float(v)) for i, v in enumerate(np.random.RandomState(0).randint(0, 40, 901))] + [(0, NAN), (1, None), (7, None)]
    df = spark.createDataFrame(values, "k int, v double")
    got = {r["k"]: (r["n"], r["upper_median"]) for r in robust.upper_median(df, ["k"], "v").collect()}
    for k in range(3):
        own = sorted(v for kk, v in values if kk == k and v is not None and not math.isnan(v))
        assert got[k] == (len(own), own[len(own) // 2])
    assert 7 not in got
    own = np.sort([v for _, v in values if v is not None and not math.isnan(v)])
    med = own[len(own) // 2]
    limit = med + 5.2 * np.sort(np.abs(own - med))[len(own) // 2]
    out = robust.x84(df, [], "v")
    assert out.filter("is_inlier").count() == (own < limit).sum() and out.count() == len(values)
    assert robust.upper_median(df.limit(0), [], "v").isEmpty()


def test_grid_selection(spark):
    r = np.random.RandomState(1)
    data = [(1, int(i), float(r.uniform(0, 80)), float(r.uniform(0, 60)), bool(r.rand() < 0.5)) for i in range(500)] + [(2, 1, 1.0, 1.0, None), (3, 2, None, None, True)]
    df = spark.createDataFrame(data, "p int, i int, x double, y double, ok boolean")
    out = selection.spread_selection(df, ["p"], F.col("x"), F.col("y"), 80.0, 60.0, "i", F.col("ok"), 100)
    sizes = {r_["p"]: r_["n"] for r_ in out.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {1: 100, 2: 1, 3: 1}
    per_cell = [r_["n"] for r_ in out.filter("p = 1").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(per_cell) == 48 and max(per_cell) <= 4


def test_reports(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 5.0), ("b", 2, None)], "algorithm string, commit int, value double")
    stats = {(r["algorithm"], r["commit"]): r for r in ev.all_stats(df, ["algorithm", "commit"], "value").collect()}
    assert stats["a", 1]["median"] == 1.5 and stats["b", 1]["stddev"] is None and stats["b", 2]["count"] == 0
    assert rows(ev.best_and_second(df.filter("commit = 1").groupBy("commit", "algorithm").agg(F.avg("value").alias("v")), ["commit"], "algorithm", "v")) == [(1, "a", 1.5, "b", 5.0)]
    lines = spark.createDataFrame([("N/A,N/A,N/A,N/A",), ("a,N/A,N/A,N/A",), (None,)], "line string")
    assert ev.drop_unavailable_lines(lines, "line").count() == 2
    noted = spark.createDataFrame([(1.0, {"x": "1", "y": "2"})], "v double, notes map<string,string>")
    assert ev.expand_notes(noted, "notes", "ALL").columns == ["v", "x", "y"] and ev.expand_notes(noted, "notes", "").columns == ["v"]
    points = spark.createDataFrame([(1, "S", 0, 1), (1, "E", 2_000_000, 2), (2, "S", 5, 3)], "s int, stage string, us long, e int").withColumn("at", F.timestamp_micros("us"))
    assert rows(profiling.intervals(points, ["s"], "stage", "at", "e")) == [(1, "S->E", 2000.0)]


def test_matching_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 16)
    r = np.random.RandomState(2)
    x = r.normal(size=(90, 12))
    x[60:] = x[30:60] + r.normal(size=(30, 12)) * 0.05
    data = [(i // 30, i, x[i].tolist()) for i in range(90)]
    df = spark.createDataFrame([*data, (None, 1, x[0].tolist()), (1, 999, None)], "view_id long, feature_id long, vec array<double>")
    got = {(m["view_i"], m["view_j"], m["query"]): (m["target"], m["distance"]) for m in matching.match_views(df, "BF", ratio=0.8).collect()}
    want = {}
    for a in range(3):
        for b in range(a + 1, 3):
            d = np.linalg.norm(x[30 * a : 30 * a + 30, None] - x[None, 30 * b : 30 * b + 30], axis=2)
            for q in range(30):
                o = np.argsort(d[q])[:2]
                if d[q, o[0]] < 0.8 * d[q, o[1]]:
                    want[a, b, 30 * a + q] = (30 * b + int(o[0]), d[q, o[0]])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    mutual = matching.match_views(df, "BF", ratio=None, cross_check=True).filter("view_i = 1 AND view_j = 2")
    assert {(m["query"], m["target"]) for m in mutual.collect()} == {(30 + i, 60 + i) for i in range(30)}
    hashed = matching.cascade_hash_matches(df, ratio=None, bits=3).filter("view_i = 1 AND view_j = 2")
    assert sum(m["target"] == m["query"] + 30 for m in hashed.collect()) >= 27
    assert matching.match_views(df.limit(0), "BF").isEmpty()
    with pytest.raises(ValueError):
        matching.match_views(df, "NONE")


def test_components_forest_and_propagation(spark):
    r = np.random.RandomState(4)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in r.randint(0, 60, (70, 2)) if a != b})
    weights = r.randint(1, 9, len(pairs))
    df = spark.createDataFrame([(a, b, int(w)) for (a, b), w in zip(pairs, weights)] + [(99, 99, 1), (None, 1, 1)], "view_i long, view_j long, weight long")
    parent = list(range(100))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted((v, find(v)) for v in {v for p in pairs for v in p} | {99})
    for finish_links in (1_000_000, 20, 0):  # in one task, after some rounds, by rounds alone
        assert sorted(map(tuple, graph.components(df, "view_i", "view_j", finish_links=finish_links).collect())) == want
    small, spread = graph.maximum_spanning_forest(df), graph.maximum_spanning_forest(df, driver_edges=0)
    assert rows(small) == rows(spread) and small.count() == len(want) - len({c for _, c in want})
    truth = random_rotations(100, 5)
    views = spark.createDataFrame([(v,) for v, _ in want], "view_id long")
    rel = spark.createDataFrame([(a, b, (truth[b] @ truth[a].T).ravel().tolist()) for a, b in pairs], "view_i long, view_j long, r array<double>")
    tree = small.join(rel, ["view_i", "view_j"])
    near, far = graph.propagate_rotations(views, tree), graph.propagate_rotations(views, tree, driver_edges=0)
    root = want[0][0]
    for out in (near, far):
        for row in out.collect():
            if find(row["view_id"]) == find(root):
                assert np.allclose(np.array(row["r"]).reshape(3, 3), truth[row["view_id"]] @ truth[root].T, atol=1e-9)
            else:
                assert row["r"] is None
    assert {(x["view_id"], x["depth"]) for x in near.collect()} == {(x["view_id"], x["depth"]) for x in far.collect()}


def noisy_graph(n, linked, noise, outliers, seed):
    """Edges of a view graph with noise and random outliers, one outlier heavy enough for the spanning tree."""
    truth, r, rel = random_rotations(n, seed), np.random.RandomState(seed + 1), []
    for i in range(n):
        for j in range(i + 1, n):
            if linked(i, j, r):
                m = solvers._exp(r.normal(size=(1, 3)) * noise)[0] @ truth[j] @ truth[i].T
                weight = float(r.randint(5, 50))
                if r.rand() < outliers or (i, j) == (2, 4) and outliers:
                    m, weight = random_rotations(1, i * 50 + j)[0], weight + 20 * ((i, j) == (2, 4))
                rel.append((i, j, weight, m.ravel().tolist()))
    return truth, rel


@pytest.mark.parametrize(("n", "linked", "noise", "outliers", "mean", "most"), [
    (12, lambda i, j, r: r.rand() < 0.7, 0.003, 0.08, 0.3, 0.8),
    (16, lambda i, j, r: j - i <= 4, 0.01, 0.1, 1.5, 4.0),
    (14, lambda i, j, r: j - i <= 2, 0.002, 0.0, 1.0, 2.0),
])
def test_rotation_averaging_is_the_same_at_any_size(spark, n, linked, noise, outliers, mean, most):
    truth, rel = noisy_graph(n, linked, noise, outliers, 6)
    pairs = spark.createDataFrame(rel, "view_i long, view_j long, weight double, r array<double>").coalesce(2)
    views = spark.createDataFrame([(i,) for i in range(n + 1)], "view_id long")
    found = []
    for driver_edges in (100_000, 0):
        got = {x["view_id"]: x["r"] for x in solvers.average_rotations(views, pairs, driver_edges=driver_edges).collect()}
        assert got.pop(n) is None
        found.append(np.array([got[i] for i in range(n)]).reshape(-1, 3, 3))
    assert np.abs(found[0] - found[1]).max() < 1e-6
    errors = np.degrees(np.linalg.norm(solvers._log(found[0] @ found[0][0].T @ np.swapaxes(truth @ truth[0].T, 1, 2)), axis=1))
    assert errors.mean() < mean and errors.max() < most


def test_least_absolute_sums_agree():
    r = np.random.RandomState(3)
    i, j = np.array([(a, b) for a in range(15) for b in range(a + 1, 15) if r.rand() < 0.5]).T
    x = r.normal(size=(15, 3))
    x[0] = 0
    b = x[j] - x[i]
    b[::9] += r.normal(size=(len(b[::9]), 3)) * 5
    assert np.abs(solvers.l1_solve(i, j, b, 15, 0) - x).max() < 0.05


def test_alignment_recovers(spark):
    r = np.random.RandomState(8)
    a, m = r.normal(size=(40, 3)), random_rotations(1, 9)[0]
    b = 2.5 * a @ m.T + [1, -2, 3]
    df = spark.createDataFrame([("s", *map(float, p), *map(float, q)) for p, q in zip(a, b)] + [("s", NAN, 0.0, 0.0, 0.0, 0.0, 0.0), ("few", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "k string, a0 double, a1 double, a2 double, b0 double, b1 double, b2 double")
    out = {x["k"]: x for x in solvers.similarity_alignment(df, ["k"], ["a0", "a1", "a2"], ["b0", "b1", "b2"]).collect()}
    assert out["few"]["scale"] is None and out["s"]["n"] == 40
    assert abs(out["s"]["scale"] - 2.5) < 1e-9 and np.allclose(np.array(out["s"]["r"]).reshape(3, 3), m) and np.allclose(out["s"]["t"], [1, -2, 3])
    s, rr, t = solvers.iterative_similarity(a, 2.5 * a @ solvers._exp(np.array([[0.1, 0.2, -0.1]]))[0].T + [1, -2, 3])
    assert abs(s - 2.5) < 1e-6 and np.allclose(t, [1, -2, 3], atol=1e-6)


def test_two_view_recovers(spark):
    r = np.random.RandomState(10)
    rotation, t = solvers._exp(np.array([[0.05, -0.1, 0.02]]))[0], np.array([0.6, 0.1, -0.2])
    x = r.uniform([-2, -2, 4], [2, 2, 8], (120, 3))
    y = x @ rotation.T + t
    b1, b2 = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    wrong = r.rand(120) < 0.2
    b2[wrong] = r.normal(size=(wrong.sum(), 3))
    b2 /= np.linalg.norm(b2, axis=1)[:, None]
    data = [(1, 2, i, b1[i].tolist(), b2[i].tolist()) for i in range(120)] + [(1, 3, i, b1[i].tolist(), b2[i].tolist()) for i in range(5)]
    out = {x["view_j"]: x for x in solvers.two_view_poses(spark.createDataFrame(data, "view_i long, view_j long, match_idx long, b1 array<double>, b2 array<double>")).collect()}
    assert out[3]["reason"] == "too_few_matches" and out[2]["reason"] == "ok"
    assert np.linalg.norm(np.array(out[2]["r"]).reshape(3, 3) - rotation) < 0.02
    assert np.dot(out[2]["t"], t / np.linalg.norm(t)) > 0.99


def test_two_view_poses_side_by_side_are_those_of_each_alone(spark):
    r = np.random.RandomState(5)
    rotation = np.linalg.qr(r.normal(size=(3, 3)))[0]
    rotation *= np.sign(np.linalg.det(rotation))
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    data = []
    for j, (n, wrong) in enumerate([(8, 0.0), (60, 0.0), (60, 0.3), (90, 0.5), (70, 1.0), (5, 0.0)]):
        x = r.normal(size=(n, 3)) + [0, 0, 5]
        b1, b2 = unit(x), unit(np.where(r.rand(n, 1) < wrong, r.normal(size=(n, 3)), x @ rotation.T + [0.5, 0.1, -0.2]))
        data.append((1, 2 + j, b1.tolist(), b2.tolist()))
    pairs = spark.createDataFrame(data, "view_i long, view_j long, b1 array<array<double>>, b2 array<array<double>>")
    found = {x["view_j"]: x for x in solvers.two_view_poses_of_lists(pairs, 8, 8).collect()}
    assert [found[j]["reason"] for j in (2, 3, 4, 7)] == ["ok", "ok", "ok", "too_few_matches"] and len(found) == 6
    for _, j, b1, b2 in data[:-1]:
        b1, b2 = np.array(b1), np.array(b2)
        e, inliers = solvers.ransac(len(b1), 8, lambda k: solvers.eight_point(b1[k], b2[k]), lambda m: solvers.epipolar_residual(m, b1, b2), 0.005, (12345 ^ (7919 + 7927 * j)) % 2**32)
        assert found[j]["inliers"] == inliers.tolist() and found[j]["n_inliers"] == inliers.sum()
        if found[j]["reason"] == "ok":
            alone = solvers.decompose_essential(e, b1[inliers], b2[inliers])
            assert np.allclose(found[j]["r"], alone[0].ravel(), atol=1e-6) and np.allclose(found[j]["t"], alone[1], atol=1e-6)


def test_two_view_poses_of_lists_needs_no_shuffle(spark):
    pairs = spark.createDataFrame([(1, 2, [[0.0, 0.0, 1.0]], [[0.0, 0.0, 1.0]])], "view_i long, view_j long, b1 array<array<double>>, b2 array<array<double>>")
    plan = solvers.two_view_poses_of_lists(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_two_view_poses_makes_its_bearings_where_pairs_are_solved(spark):
    from sightline.plans import conversions

    plan = conversions.two_view_poses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "sequence(" not in plan  # else a pair's pose is worked out again for each point
    assert [s.permutation(60)[:8].tolist() for s in solvers._seeded(np.array([7, 2**32 - 1]))[:2]] == [np.random.RandomState(k).choice(60, 8, replace=False).tolist() for k in (7, 2**32 - 1)]
    seen = lambda batch: (batch["n"].to_numpy(), *[np.repeat([[0.0, 0.0, 1.0]], sum(batch["n"].to_pylist()), axis=0)] * 2)
    pairs = spark.createDataFrame([(1, 2, 60), (1, 3, 20), (1, 4, 55)], "view_i long, view_j long, n long")
    assert {(r["view_j"], r["n_matches"], len(r["inliers"] or [])) for r in solvers.two_view_poses_where_seen(pairs, F.col("n"), seen).collect()} == {(2, 60, 60), (3, 20, 0), (4, 55, 55)}


def test_model_operators(spark):
    m = spark.createDataFrame([(1, 2, 0, 5, 6, True), (1, 2, 1, 7, 8, None), (3, 4, 0, 1, 1, True)], "view_i long, view_j long, match_idx long, feat_i long, feat_j long, is_inlier boolean")
    kept = {(r["view_i"], r["match_idx"]): r["is_inlier"] for r in st.keep_matched_pairs(m, 2).collect()}
    assert kept == {(1, 0): True, (1, 1): False, (3, 0): False}
    found = spark.createDataFrame([(1, 2, 0, False)], "view_i long, view_j long, nth long, ok boolean")
    assert not any(r["is_inlier"] for r in st.sync_inliers(m, found).collect())
    assert st.planar_grid(4, 3, 0.5, True, spark).agg(F.sum("x"), F.sum("y"), F.count("idx")).first() == (0.0, 0.0, 12)
    obs = spark.createDataFrame([(1, 0, v, 0, True) for v in (9, 4, 4, 30)] + [(2, 0, 77, 0, False)], "track_id long, obs_idx int, view_id long, feature_id long, is_used boolean")
    assert rows(st.valid_views(obs)) == [(30, 2), (4, 0), (9, 1)]
    centres = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0), ("s", 2, 0.0, 0.0, 0.001), ("s", 3, 4.0, 0.0, 0.0), ("one", 4, 9.0, 0.0, 0.0), (None, 5, 0.0, 0.0, 0.0)], "s string, i int, x double, y double, z double")
    (_, greatest, least, scale), = st.scene_scale(centres, "s", "x", "y", "z", "i").collect()
    assert abs(greatest - 4.0) < 1e-6 and abs(least - 4.0) < 1e-6 and abs(scale - 0.25) < 1e-6
