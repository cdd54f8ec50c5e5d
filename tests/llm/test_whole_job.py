"""Vectors that cells alone do not bring together: dense regions, chains, clusters over many cells."""

import random
import time

import numpy as np
import pytest

from sightline.llm import clusters, exact, leakage, neighbours, tokenizer, vectors
from test_training_data import VOCABULARY, closed_sets, nearest_pairs, usable


def frame(spark, x, repeat=()):
    data = [(100 + i, v.tolist(), "x") for i, v in enumerate(x)] + [(9000 + i, x[i].tolist(), "x") for i in repeat]
    return data, spark.createDataFrame(data, "kp_id long, descriptor array<smallint>, id string")


def dense_and_other(seed=4, n=400):
    """A third of the rows about 100 apart in one region, groups of a few and single vectors for the rest."""
    r = np.random.RandomState(seed)
    centre = r.uniform(60, 190, 128)
    dense = centre + r.normal(0, 100 / 16, (n, 128))
    groups = np.repeat(r.exponential(45, (n // 4, 128)), 4, axis=0) + r.normal(0, 5, (n // 4 * 4, 128))
    return np.clip(np.concatenate([dense, groups, r.exponential(45, (n, 128))]), 0, 255).round().astype(int)


def test_dense_region_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    monkeypatch.setattr(exact, "BLOCK", 256)
    data, df = frame(spark, dense_and_other(), range(0, 400, 40))
    monkeypatch.setattr(vectors, "DIVIDED_ROWS", 40)
    monkeypatch.setattr(vectors, "INNER_ROWS", 20)
    pivots = vectors.fit_pivots(df, "kp_id", "descriptor").every
    x = np.array(list(usable(data).values()), np.float32)[:400]
    assert len(set(((x[:, None] - pivots[None]) ** 2).sum(2).argmin(1))) >= 6  # the region is cut into cells
    want = {(a, b, d) for a, near in nearest_pairs(usable(data), 5, 120.0).items() for b, d in near}
    got = {(r["id"], r["neighbour"], r["squared_distance"]) for r in neighbours.similar_vectors(df, "kp_id", "descriptor", 5, 120.0, exact=True).collect()}
    assert got == want


def chains(seed=6, n=12, length=12):
    """Chains whose neighbours are 230 apart in random directions, and single vectors."""
    r = np.random.RandomState(seed)
    out = [r.exponential(45, (150, 128))]
    for _ in range(n):
        step = r.normal(size=(length, 128))
        out.append(r.uniform(90, 150, 128) + np.cumsum(230 * step / np.linalg.norm(step, axis=1)[:, None], axis=0))
    return np.clip(np.concatenate(out), 0, 255).round().astype(int)


def test_chains_of_single_links_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    monkeypatch.setattr(exact, "BLOCK", 64)
    data, df = frame(spark, chains(), (150, 200))
    want = closed_sets(usable(data), 240.0, 8)
    assert len(want) > 100 and len({c for _, c in want}) > 5
    assert {(r["id"], r["cluster_id"]) for r in clusters.similarity_clusters(df, "kp_id", "descriptor", exact=True).collect()} == want


def test_members_are_found_where_no_cell_brings_them_together(spark, monkeypatch):
    """Without being asked for, links across cells are found, of single vectors, of balls and of balls of several parts."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    monkeypatch.setattr(exact, "BLOCK", 64)
    monkeypatch.setattr(clusters, "GROUP_ROWS", 4)
    data, df = frame(spark, np.concatenate([chains(seed=8), dense_and_other(seed=9, n=100)]), (150, 200))
    want = closed_sets(usable(data), 240.0, 8)
    assert {(r["id"], r["cluster_id"]) for r in clusters.cluster_members(df, "kp_id", "descriptor", exact=False).collect()} != want
    assert {(r["id"], r["cluster_id"]) for r in clusters.cluster_members(df, "kp_id", "descriptor").collect()} == want


def test_single_vectors_are_compared_by_few_directions_whatever_balls_stand_beside_them():
    r = np.random.RandomState(12)
    lone = r.exponential(45, (1400, 128))
    lone[700:760] = lone[:60] + r.normal(0, 1, (60, 128)) * np.linspace(16, 26, 60)[:, None]  # 180 to 300 apart
    tight = [c + r.normal(0, w, (5, 128)) for c, w in zip(r.exponential(45, (160, 128)), np.linspace(1, 14, 160))]
    tight[80:] = [t + r.normal(0, 1, 128) * 28 for t in tight[:80]]
    x = np.clip(np.concatenate([lone, *tight]), 0, 255).round().astype(np.uint8)
    label = np.r_[np.arange(1400), 1400 + np.repeat(np.arange(160) * 5, 5)]
    first, about = clusters._balls(x, label)
    bound = exact.Bound(x[::9].astype(np.float32), np.inf)
    rows = {"root": label[first], "radius": about["radius"].to_numpy(), "vec": vectors.unpacked(about["centre"]), "members": about["members"].to_numpy(zero_copy_only=False)}
    part = r.rand(len(first)) < 0.5
    a, b = (clusters._Balls({c: v[p] for c, v in rows.items()}, bound) for p in (part, ~part))
    assert clusters.GRADES[a.grade(240.0**2)] <= 64 < clusters.GRADES[a.grade((240.0 + 2 * a.radius.max()) ** 2)]
    for p, q in ((a, b), (b, a), (a, a)):
        apart = np.sqrt(((p.x[:, None].astype(np.float32) - q.x[None].astype(np.float32)) ** 2).sum(2))
        want = {(i, j) for i, j in np.argwhere(apart <= 240 + p.radius[:, None] + q.radius[None]).tolist() if p.root[i] != q.root[j]}
        got = {ij for i, j in clusters._near_balls(p, q, 240.0**2) for ij in zip(i.tolist(), j.tolist())}
        assert want and (want <= got or p is q and want <= got | {(j, i) for i, j in got})
        assert len(got) <= 1.2 * len(want) + 10


def test_one_cluster_over_many_cells_is_described_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 10)
    monkeypatch.setattr(exact, "BLOCK", 64)
    x = np.concatenate([dense_and_other(n=120), chains(n=6)])
    data, df = frame(spark, x)
    assert len(vectors.fit_pivots(df, "kp_id", "descriptor").every) >= 20
    points = usable(data)
    groups = {}
    for i, c in sorted(closed_sets(points, 240.0, 8)):
        groups.setdefault(c, []).append(i)
    want = set()
    for c, ids in groups.items():
        degree, centre = clusters._describe(np.array([points[i] for i in ids], np.uint8), np.zeros(len(ids), int), 240.0**2)
        want |= {(i, c, int(d), ids[m]) for i, d, m in zip(ids, degree, centre)}
    parts = {c: len({m for _, k, _, m in want if k == c}) for c in groups}
    assert parts[100] == 1 and len(groups[100]) == 120 and max(parts.values()) > 1
    for together in (4096, 9):  # by one task each, and by blocks and joins
        found = clusters.similarity_clusters(df, "kp_id", "descriptor", together=together, exact=True)
        assert {tuple(r) for r in found.collect()} == want
    assert {r["cluster_id"]: r["n_parts"] for r in clusters.describe_clusters(found).collect()} == parts


def test_dense_region_divided_by_inner_pivots(spark, monkeypatch):
    """The region is cut into cells as it is where it holds a third of 200,000 rows; most neighbours are still found."""
    monkeypatch.setattr(vectors, "DIVIDED_ROWS", 160)
    monkeypatch.setattr(vectors, "INNER_ROWS", 80)
    data, df = frame(spark, dense_and_other(n=600))
    pivots = vectors.fit_pivots(df, "kp_id", "descriptor")
    assert pivots.inner and len(pivots.every) >= len(pivots.points) + 6
    want = {(a, b) for a, near in nearest_pairs(usable(data), 5, 120.0).items() for b, _ in near}
    got = {(r["id"], r["neighbour"]) for r in neighbours.similar_vectors(df, "kp_id", "descriptor", 5, 120.0).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_cell_of_many_parts_is_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "DIVIDED_ROWS", 10**9)
    monkeypatch.setattr(vectors, "PART_ROWS", 50)
    data, df = frame(spark, dense_and_other(n=300), range(0, 300, 30))
    pivots = vectors.fit_pivots(df, "kp_id", "descriptor")
    assert max(pivots.parts.values()) >= 6
    want = {(a, b) for a, near in nearest_pairs(usable(data), 5, 120.0).items() for b, _ in near}
    got = {(r["id"], r["neighbour"]) for r in neighbours.similar_vectors(df, "kp_id", "descriptor", 5, 120.0).collect()}
    assert len(got & want) / len(want) >= 0.97
    found = {(r["id"], r["cluster_id"]) for r in clusters.cluster_members(df, "kp_id", "descriptor").collect()}
    assert found == closed_sets(usable(data), 240.0, 8)


def test_chains_where_vectors_visit_the_cells_they_are_near_to(spark):
    data, df = frame(spark, chains(n=30), (150, 200))
    want = closed_sets(usable(data), 240.0, 8)
    assert {(r["id"], r["cluster_id"]) for r in clusters.cluster_members(df, "kp_id", "descriptor").collect()} == want


@pytest.mark.parametrize(("n", "letters"), [(1_000_000, "abcdefghijklmnopqrstuvwxyz"), (200_000, "ACDEFGHIKLMNPQRSTVWY"), (100_000, "a"), (50_000, "ab漢é")])
def test_long_unbroken_words(n, letters):
    from tokenizers import Tokenizer

    word = "".join(random.Random(4).choices(letters, k=n))
    merger = tokenizer.Merger(tokenizer.load_vocabulary(VOCABULARY))
    began = time.time()
    assert merger.encode([word])[0] == Tokenizer.from_file(VOCABULARY).encode(word, add_special_tokens=False).ids
    assert time.time() - began < 30


def test_heap_and_query_contract_alike(monkeypatch):
    vocabulary, r = tokenizer.load_vocabulary(VOCABULARY), random.Random(5)
    texts = ["".join(r.choices("abcdee ing漢é-1", k=r.randint(1, 300))) for _ in range(40)]
    query = tokenizer.Merger(vocabulary).encode(texts)
    monkeypatch.setattr(tokenizer, "LONG_WORD", 1)
    assert tokenizer.Merger(vocabulary).encode(texts) == query


def test_index_holds_every_word_of_every_document(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_DOCUMENTS", 2)
    docs = spark.createDataFrame([(7, "b a b"), (8, None), (9, ""), (10, "A c"), (None, "d"), (11, "b")], "doc_id long, text string").coalesce(1)
    index = leakage.build_index(docs, "doc_id", "text").collect()
    ids = {r["shard"]: r["ids"] for r in index if r["term"] is None}
    got = {(r["term"], ids[r["shard"]][d], p) for r in index if r["term"] for d, p in zip(r["docs"], r["positions"])}
    assert got == {("a", 7, 1), ("b", 7, 0), ("b", 7, 2), ("a", 10, 0), ("c", 10, 1), ("b", 11, 0)}
    assert sorted(ids.values()) == [[7, 10], [11]] and all(r["n"] == len(r["docs"]) for r in index)


def test_too_large_an_evaluation_set_says_so(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_ITEM_CHARS", 3)
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    with pytest.raises(ValueError):
        leakage.find_leaks(one, one.withColumnRenamed("doc_id", "item_id"))
