"""Training-data operators against brute force, round trips and held-out rows, on small fixtures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import clusters, leakage, neighbours, subjects, textnorm, vectors
from sightline.llm.components import connected_components, keypoint_links
from sightline.llm.proximity_graph import ProximityGraph
from sightline.llm.tokenizer import decode_corpus, encode_corpus

VOCABULARY = os.environ.get("SIGHTLINE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- vectors: p1 and p4


def descriptors(seed=0, groups=12, size=14, noise=150):
    r = np.random.RandomState(seed)
    centres = np.clip(r.exponential(45, (groups, 128)), 0, 255)
    x = np.concatenate([np.clip(c + r.normal(0, 6, (size, 128)), 0, 255) for c in centres] + [np.clip(r.exponential(45, (noise, 128)), 0, 255)])
    return x.round().astype(int)


def dirty(x):
    """Descriptor rows with copies, repeats, unusable values and an extra column."""
    data = [(1000 + i, v.tolist()) for i, v in enumerate(x)]
    data += [(10 + i, x[0].tolist()) for i in range(9)] + data[:5]
    data += [(1, None), (2, []), (3, x[0, :127].tolist()), (4, [0] * 128), (5, [*x[0, :127].tolist(), 256]), (6, [*x[0, :127].tolist(), -1]), (7, [*x[0, :127].tolist(), None]), (None, x[1].tolist())]
    return [(k, v, "x") for k, v in data]


DESCRIPTORS = "kp_id long, descriptor array<smallint>, id string"


def usable(data):
    out = {}
    for k, v, _ in data:
        if k is not None and v is not None and len(v) == 128 and None not in v and min(v) >= 0 and max(v) <= 255 and max(v) > 0:
            out[k] = np.array(v)
    return out


def nearest_pairs(points, k, limit):
    ids = np.array(sorted(points))
    x = np.array([points[i] for i in ids])
    d = ((x[:, None].astype(int) - x[None]) ** 2).sum(2)
    out = {}
    for a in range(len(ids)):
        order = [b for b in np.lexsort((ids, d[a])) if b != a][:k]
        out[int(ids[a])] = [(int(ids[b]), int(d[a, b])) for b in order if d[a, b] <= limit**2]
    return out


@pytest.fixture(scope="module")
def described(spark):
    data = dirty(descriptors())
    return data, spark.createDataFrame(data, DESCRIPTORS)


def test_similar_vectors_against_brute_force(described):
    data, df = described
    want = nearest_pairs(usable(data), 5, 120.0)
    got = {}
    for r in neighbours.similar_vectors(df, "kp_id", "descriptor", 5, 120.0).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["squared_distance"]))
    found = {(a, b) for a, near in got.items() for _, b, _ in near}
    true = {(a, b) for a, near in want.items() for b, _ in near}
    assert len(found & true) / len(true) >= 0.97
    assert all([n for n, _, _ in sorted(near)] == list(range(1, len(near) + 1)) for near in got.values())
    for copy in (10, 14, 18, 1000):  # exact copies have each other, the smaller ids first
        assert [b for _, b, _ in sorted(got[copy])] == [b for b, _ in want[copy]]


def test_similar_vectors_of_copies_only_and_nothing(spark, described):
    _, df = described
    same = df.filter("kp_id BETWEEN 10 AND 18").repartition(3)
    got = rows(neighbours.similar_vectors(same, "kp_id", "descriptor", 5, 120.0).groupBy("id").agg(F.sort_array(F.collect_list("neighbour"))))
    assert got[0] == (10, [11, 12, 13, 14, 15]) and got[-1] == (18, [10, 11, 12, 13, 14]) and len(got) == 9
    assert neighbours.similar_vectors(df.limit(0), "kp_id", "descriptor").isEmpty()
    assert neighbours.similar_vectors(df.filter("kp_id < 8"), "kp_id", "descriptor").isEmpty()
    assert neighbours.similar_vectors(df.filter("kp_id = 10"), "kp_id", "descriptor").isEmpty()


def test_graph_recall_and_pruning():
    x = descriptors(3, 30, 40, 500).astype(np.float32)
    graph = ProximityGraph(x, 24, 10, 1.1, 2)
    exact = np.argsort(((x[:, None] - x[None]) ** 2).sum(2) + np.eye(len(x)) * 1e12, axis=1)[:, :5]
    near = graph.search_own()[0]
    groups = 30 * 40
    assert np.mean([len(set(exact[i]) & set(near[i])) / 5 for i in range(groups)]) >= 0.95
    guests = graph.search(x[:groups])[0]
    assert np.mean([guests[i, 0] == i for i in range(groups)]) >= 0.98
    assert (graph.edges[:-1] < graph.n).sum(1).max() <= 24 and not (graph.edges[:-1] == np.arange(graph.n)[:, None]).any()


def test_more_shards_lose_little(described, monkeypatch):
    data, df = described
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    want = {(a, b) for a, near in nearest_pairs(usable(data), 5, 120.0).items() for b, _ in near}
    got = {(r["id"], r["neighbour"]) for r in neighbours.similar_vectors(df, "kp_id", "descriptor", 5, 120.0).collect()}
    assert len(got & want) / len(want) >= 0.9


def closed_sets(points, limit, least):
    ids = sorted(points)
    x = np.array([points[i] for i in ids])
    near = ((x[:, None].astype(int) - x[None]) ** 2).sum(2) <= limit**2
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {(ids[i], ids[label[i]]) for i in range(len(ids)) if (label == label[i]).sum() >= least}


def test_clusters_against_brute_force(described):
    data, df = described
    want = closed_sets(usable(data), 240.0, 8)
    found = clusters.similarity_clusters(df, "kp_id", "descriptor")
    got = {(r["id"], r["cluster_id"]) for r in found.collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97
    described_ = {r["cluster_id"]: r for r in clusters.describe_clusters(found).collect()}
    sizes = {}
    for _, c in got:
        sizes[c] = sizes.get(c, 0) + 1
    assert {c: r["size"] for c, r in described_.items()} == sizes
    assert all(len(r["typical"]) == 3 and r["n_parts"] >= 1 for r in described_.values())
    assert clusters.similarity_clusters(df.limit(0), "kp_id", "descriptor").isEmpty()


def test_loose_component_is_divided():
    chain = np.zeros((30, 128), np.uint8)
    chain[:, 0] = 1
    for i in range(30):
        chain[i, 1 : 1 + 4 * (i + 1)] = 100  # neighbours are 200 apart
    label = np.zeros(30, int)
    degree, centre = clusters._describe(chain, label, 240.0**2)
    assert degree.max() == 2 and len(set(centre)) >= 10
    tight = np.full((9, 128), 9, np.uint8)
    assert len(set(clusters._describe(tight, np.zeros(9, int), 240.0**2)[1])) == 1


# --- p2


def brute_components(pairs):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return sorted((v, find(v)) for v in parent)


@pytest.mark.parametrize("kind", ["random", "path", "star", "mixed"])
def test_components_against_union_find(spark, kind):
    r = np.random.RandomState(1)
    p = r.permutation(200)
    pairs = {
        "random": [(int(a), int(b)) for a, b in r.randint(0, 300, (260, 2))], "path": [(int(a), int(b)) for a, b in zip(p, p[1:])],
        "star": [(500, i) for i in range(1, 400)], "mixed": [(1, 2), (2, 1), (1, 1), (None, 4), (5, None), (7, 7), (2, 3), (9, 8), (9, 8)],
    }[kind]
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a long, b long, group_id string")
    assert sorted(map(tuple, connected_components(df).collect())) == brute_components(pairs)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_keypoint_links(spark):
    keypoints = spark.createDataFrame([(100 + 10 * v + i, v, i) for v in range(4) for i in range(4)] * 2, "kp_id long, image_id long, kp_idx int")
    matches = spark.createDataFrame([(0, 1, 0, 0, True), (1, 0, 0, 0, True), (0, 2, 1, 1, None), (0, 2, 2, 2, False), (0, 9, 3, 3, True), (3, 3, 3, 3, True), (None, 1, 1, 1, True)], "view_i long, view_j long, feat_i long, feat_j long, is_inlier boolean")
    track = "point_id long, is_used boolean, track array<struct<image_id:bigint,point2d_idx:int>>"
    points = spark.createDataFrame([(1, True, [(1, 0), (9, 9), (2, 3), None]), (2, False, [(0, 3), (1, 3)]), (3, True, None), (4, True, []), (5, True, [(3, 1), (None, 1)]), (1, True, [(3, 0), (3, 2)])], track)
    got = sorted(map(tuple, connected_components(keypoint_links(keypoints, matches, points)).collect()))
    assert got == [(100, 100), (110, 100), (123, 100), (130, 130), (132, 130)]


# --- p6


TEXTS = [
    None, "", " ", "\n\n \t", "Hello world's  finest", "<|endoftext|> is text", "Schlüsselpunkt über 12345 Zuordnungen", "空心的方盒里面，蓝色磁铁", "a" * 3000, "=" * 777, "é" * 50, "👩‍🔬🏛️ ok", "​﻿\x00x",
    "don't you'll WE'VE", " leading and trailing  ", "x1y2 3.14e-10", "".join(chr(97 + i * i % 26) for i in range(4000)), "ａｂｃ ß ſ",
]


def test_encoding_equals_the_library_and_decodes(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    data = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en"), (None, "no id", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    ids = encode_corpus(df, VOCABULARY)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert ids.count() == len(data)
    for i, t in enumerate(TEXTS):
        assert got[i] == (library.encode(t, add_special_tokens=False).ids if t else []), t
    back = {r["doc_id"]: r["text"] for r in decode_corpus(ids, VOCABULARY).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert encode_corpus(df.limit(0), VOCABULARY).isEmpty()


# --- p7


OPENING = "Read the riddle with care and then give one short answer in plain words without a sketch."
A = "At the stroke of noon the crooked little key is stacked below all of a bent hairpin once the music has stopped; who could still reach the string?"
B = "Across a felt mat a paper swan with bent wings circles backwards around the sleeping cat's cushion because the rope is too short; which side is it?"
C = "帷幕后面的桌边最小的套娃倒立着旋转停在空饼干盒旁边抽屉始终开着问哪一对交换了位置是谁先动"


def leaks(spark, texts):
    items = spark.createDataFrame([(1, f"{OPENING} {A}", "en"), (2, f"{B} {OPENING}", None), (3, C, "zh"), (4, None, None), (5, "too short", "en"), (1, f"{OPENING} {A}", "en")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    return {(r["doc_id"], r["item_id"]): r for r in leakage.find_leaks(docs, items).collect()}


def test_leaks(spark):
    w = A.split()
    changed = w[:20]
    changed[5], changed[15] = "purple", "banana"
    texts = [
        None, "", A, A.upper(), "Some words. " + " ".join(w[:14]) + " and on.", " ".join(w[:11]), " ".join(changed), " ".join(w[:6] + ["x", "y"] + w[6:14]), OPENING, f"{OPENING} {OPENING}",
        A.replace(" ", "&nbsp;"), A.replace(" ", "<br/>"), "> " + A.replace("noon", "<b>n​oon</b>").replace("key", "**key**"), A.replace("o", "о").replace("a", "а"), A.translate({ord(c): 0xFEE0 + ord(c) for c in "abcdefghij"}),
        C[:29], C[:20], " ".join(sorted(w)), A + " filler " * 40 + B, B.replace("ä", "a"),
    ]
    got = leaks(spark, texts)
    assert sorted(got) == [(2, 1), (3, 1), (4, 1), (6, 1), (10, 1), (11, 1), (12, 1), (13, 1), (14, 1), (15, 3), (18, 1), (18, 2), (19, 2)]
    assert got[2, 1]["kind"] == "phrase" and got[6, 1]["n_changes"] >= 2


def test_long_documents_and_no_items(spark):
    long = "filler words about nothing " * 20_000 + A + " more filler" * 20_000
    assert sorted(leaks(spark, [long])) == [(0, 1)]
    docs = spark.createDataFrame([(1, A)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert leakage.find_leaks(docs, none).isEmpty()
    assert leakage.find_leaks(docs.limit(0), spark.createDataFrame([(1, A)], "item_id long, text string")).isEmpty()


def test_stretches_against_edit_distance():
    """The diagonal search finds what a full search over all substrings of item and text finds."""
    r = np.random.RandomState(5)

    def best_by_force(item, doc):
        for i in range(len(item)):
            row = {(0, j): 0 for j in range(len(doc) + 1)}
            for n in range(1, len(item) - i + 1):
                new = {}
                for j in range(len(doc) + 1):
                    options = [row[0, j] + 1]
                    if j:
                        options += [row[0, j - 1] + (item[i + n - 1] != doc[j - 1]), new[0, j - 1] + 1]
                    new[0, j] = min(options)
                row = new
                if n >= 14 and 10 * min(row.values()) <= n:
                    return True
        return False

    agree = 0
    for _ in range(60):
        item = r.randint(0, 500, 30).tolist()
        doc = r.randint(0, 500, 10).tolist() + item[3 : 3 + r.randint(12, 27)] + r.randint(0, 500, 10).tolist()
        for _ in range(r.randint(0, 4)):
            at = r.randint(10, len(doc) - 10)
            doc[at : at + r.randint(0, 2)] = r.randint(0, 500, r.randint(0, 2)).tolist()
        spec = leakage.Item(1, tuple(item), (True,) * 30, 14)
        found = any(leakage._stretch(spec, doc, d) for d in range(-30, len(doc)))
        agree += found == best_by_force(item, doc)
    assert agree == 60


def test_words_of_altered_writing():
    assert textnorm.words("Café &amp; <i>b</i>AR​S") == ["cafe", "bars"] or textnorm.words("Café &amp; <i>b</i>AR") == ["cafe", "b", "ar"]
    assert textnorm.words("SchrÃ¤g") == ["schrag"] and textnorm.words(None) == [] and textnorm.words(" \n ") == []
    assert textnorm.words("2024-01-02 03:04:05 [INFO] w3: text here") == ["text", "here"]
    assert textnorm.words("exam-\nple") == ["example"] and textnorm.words("空盒3个") == ["空", "盒", "3", "个"]


# --- p8


def corpus(seed, n):
    r = np.random.RandomState(seed)
    topic = {"optics": ["the lens bends", "a prism splits", "our mirror shows"], "law": ["the court ruled", "a licence ends", "the treaty binds"]}
    ends = {"optics": ["light into colours", "an image at the focus"], "law": ["after the appeal", "under section nine"]}
    filler = ["More to follow.", "Nothing else changed.", "Thanks for the answer."]

    def say(t):
        return f"{r.choice(topic[t])} {r.choice(ends[t])}.".capitalize()

    docs = []
    for i in range(n):
        areas = [["optics"], ["law"], ["optics", "law"], []][r.randint(4)]
        parts = [say(a) for a in areas for _ in range(4)] + list(r.choice(filler, 3)) + ([say("law")] if not areas else [])
        if not areas:
            parts += list(r.choice(filler, 12))
        r.shuffle(parts)
        docs.append((i, "# Optics and law\n\n" + " ".join(parts) + "\n\n```\nthe lens bends light into colours.\n```", set(areas)))
    return docs


def test_subjects_on_held_out_documents(spark):
    docs = corpus(1, 400)
    extra = [(1000, None, set()), (1001, "", set()), (1002, "??? 12 34\n" * 50, set()), (1003, "the lens bends light into colours. " * 3000, {"optics"})]
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in docs + extra], "doc_id long, text string, subject string")
    labels = [(i, a) for i, _, areas in docs[:200] for a in (areas or {None})]
    labels = [(i, "Law " if a == "law" and i % 5 == 0 else a) for i, a in labels] + labels[:9] + [(3, "unheard of"), (None, "law")]
    labels = spark.createDataFrame(labels, "doc_id long, subject string")
    areas = spark.createDataFrame([("optics", "", ""), ("law", "", "")], "subject string, title string, description string")
    got = {(r["doc_id"], r["subject"]) for r in subjects.assign_subjects(table, labels, areas).collect()}
    want = {(i, a) for i, _, s in docs[200:] + extra for a in s}
    got = {g for g in got if g[0] >= 200}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95
    assert subjects.assign_subjects(table, labels.limit(0), areas).isEmpty()
    assert subjects.assign_subjects(table.limit(0), labels, areas).isEmpty()


def test_rules_are_pruned_and_calibrated():
    support = {frozenset("a"): 10, frozenset("b"): 10, frozenset("ab"): 5}
    kept = subjects._prune({frozenset("a"): {"x": 9}, frozenset("ab"): {"x": 4, "y": 1}, frozenset("b"): {"x": 5}}, support, 0.55)
    assert {tuple(sorted(a)) for a, _, _ in kept} == {("a",)}
    assert not subjects._prune({frozenset("a"): {"x": 9}}, support, 0.55, {"x": 0.85}) and subjects._prune({frozenset("a"): {"x": 9}}, support, 0.55, {"x": 0.1})
    rules = subjects.Rules({"a": [(frozenset("a"), "x", 0.8)]}, [(0.0, 0.3), (0.75, 0.9)])
    assert rules.judge(["a", "c"]) == ("x", 0.8) and rules.judge(["c"]) is None and rules.worth(0.8) == 0.9


def test_sentences():
    text = "# Heading here\n\nFirst one is 2.5 long. Second one!\r\n\r\n- third item\n- fourth item\n```\ncode line here\n```\n空心方盒。第二句话"
    assert len(subjects.sentences(text)) == 6
    assert subjects.sentences(None) == [] and subjects.sentences("12 34.\n---") == []
