"""Near duplicates of texts and vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import near_dedup as near
from canvass.llm.components import components
from canvass.llm.darts import signatures
from canvass.llm.hnsw import Hnsw, largest
from canvass.llm.near_vectors import near_vectors


def classes(ids, linked):
    """Smallest id connected, over all pairs."""
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if root[b] < root[a] and linked(a, b):
                    root[a], changed = root[b], True
    return root


def texts_of(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        base = [draw.choice(words) for _ in range(draw.choice([6, 40, 300]))]
        rows.append(" ".join(base))
        for _ in range(draw.randint(0, 5)):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 40))):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(draw.choice([" ", "\n"]).join(copy))
    return rows + ["one two", "one  two", "", None, " ", rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_of_texts(spark, seed):
    texts = texts_of(seed)
    sets = {i: set(near.set_of(t or "", 5).tolist()) for i, t in enumerate(texts)}

    def linked(a, b):
        return bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    expected = classes(list(sets), linked)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, texts[0], 1, "x"), (3, texts[3], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, kept string")
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == expected
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    kept = near.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None and i != 3) == sorted(i for i, c in expected.items() if i == c and i != 3)
    assert ids.count(None) == 1  # without an id nothing is compared


def test_no_texts(spark):
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_buckets_are_split_and_meet_again(spark, monkeypatch):
    """Parts of at most four members, all alike, are still connected."""
    monkeypatch.setattr(near, "CHUNK", 4)
    sig = bytes(range(150))
    members = spark.createDataFrame([(i, sig, [1, 2]) for i in range(40)], "node long, sig binary, bands array<long>")
    links = near.proposals(members, 0.6)
    roots = {r["node"]: r["root"] for r in components(links.select("a", "b")).collect()}
    assert roots == dict.fromkeys(range(40), 0)
    assert links.count() < 40 * 39 / 2


def test_a_crowded_bucket_connects_pairs_without_a_hub(spark):
    """All texts meet in one bucket only, and most pairs hold none of its hubs."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(100):
        words, sig = [f"w{k}x{i}" for i in range(60)], rng.integers(0, 256, 150, dtype=np.uint8).tobytes()
        rows += [(2 * k, " ".join(words), sig, [7, 100 + 2 * k]), (2 * k + 1, " ".join(words + ["end"]), sig, [7, 101 + 2 * k])]
    docs = near.sources(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    signs = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "node long, sig binary, bands array<long>")
    classes = docs.join(signs, F.col("doc_id") == F.col("node")).select("node", *near.SAME, "sig", "bands")
    found = {r["node"]: r["root"] for r in near.connected(classes, docs, 5, 0.8).collect()}
    assert found == {i: i - i % 2 for i in range(200)}


@pytest.mark.parametrize("block", [3, 1000])
def test_blocks_of_a_crowded_bucket_all_meet(spark, monkeypatch, block):
    """All pairs of different components are found, whichever blocks they are dealt to."""
    monkeypatch.setattr(near, "BLOCK", block)
    rows = [(i, f"a b c d e f g {i}" if i % 2 else f"a b c d e f {i} g") for i in range(40)]
    docs = near.sources(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = docs.select(F.col("doc_id").alias("node"), *near.SAME, F.lit(bytes(range(150))).alias("sig"),
                          F.array(F.lit(7).cast("long"), F.col("doc_id") + 100).alias("bands"))
    roots = spark.createDataFrame([(i, 0) for i in range(25)], "node long, root long")
    found = near.crowded(classes, docs, roots, 5, 0.0).collect()
    wanted = {(a, b) for b in range(25, 40) for a in range(b)}
    assert sorted((r["a"], r["b"]) for r in found) == sorted(wanted)


def test_a_bucket_proposes_a_bounded_number_of_links():
    rng = np.random.default_rng(0)
    sigs = np.tile(rng.integers(0, 256, 150, dtype=np.uint8), (500, 1))
    key, a, b, like = near.bucket_links(7, False, np.arange(500), sigs, 0.6)
    assert set(key) == {7} and len(a) <= 500 * 2 and like.min() >= 0.6
    assert set(a) | set(b) == set(range(500))


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_the_similarity(weighted):
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(120):
        n = int(rng.integers(5, 400))
        elements = rng.integers(0, 2**63, n, dtype=np.uint64)
        first, second = (rng.exponential(3, (2, n)) if weighted else rng.integers(0, 2, (2, n)) + 0.0)
        a, b = elements[first > 0], elements[second > 0]
        sig = signatures(np.append(a, b), np.repeat([0, 1], [len(a), len(b)]), 2, 150, np.append(first[first > 0], second[second > 0]))
        errors.append((sig[0] == sig[1]).mean() - np.minimum(first, second).sum() / np.maximum(first, second).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06
    again = signatures(np.append(elements, elements), np.zeros(2 * n, int), 1, 150)
    assert (again == signatures(elements, np.zeros(n, int), 1, 150)).all()
    assert not signatures(elements[:0], np.zeros(0, int), 1, 150).any()


def test_components(spark):
    draw = random.Random(6)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(70)] + [(5, 5), (None, 3)]
    nodes = {n for a, b in edges if None not in (a, b) and a != b for n in (a, b)}
    pairs = {frozenset(e) for e in edges}
    expected = classes(sorted(nodes), lambda a, b: frozenset((a, b)) in pairs)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == expected and len(got) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed, many=60, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    rows = [(i, (centres[i % 12] + rng.normal(size=size) * rng.choice([0.05, 0.3])).tolist()) for i in range(many)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (101, rows[3][1]), (102, [x * 1e200 for x in rows[5][1]])]
    rows += [(110, None), (111, []), (112, [0.0] * size), (113, [None] + [1.0] * 7), (114, [float("nan")] * size), (115, [float("inf")] * size)]
    return rows + [(120, rows[0][1][:3]), (None, rows[7][1])]


@pytest.mark.parametrize("shard", [16, 1 << 14])
def test_links_of_vectors(spark, shard):
    rows = vectors(1)
    full = np.zeros((len(rows), 8))
    sound = []
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            scaled = np.array(v) / np.abs(v).max()
            full[k, :len(v)] = scaled / np.linalg.norm(scaled)
            sound.append(k)
    cosine = full @ full.T
    linked = [[a != b and a in sound and b in sound and cosine[a, b] >= 0.9 for b in range(len(rows))] for a in range(len(rows))]
    root = classes(list(range(len(rows))), lambda a, b: linked[a][b])
    lowest = {r: min((rows[k][0] for k in root if root[k] == r and rows[k][0] is not None), default=None) for r in root.values()}
    expected = sorted((str(rows[k][0]), sum(linked[k]), lowest[root[k]]) for k in root)
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, cls int, root int")
    got = near_vectors(frame, shard=shard).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in got) == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in near_vectors(none).collect()] == [(1, 0, 1, True)]
    assert near_vectors(none.limit(0)).count() == 0


@pytest.mark.parametrize("many", [1, 2, 40, 3000])
def test_graph_search_finds_the_nearest(many):
    rng = np.random.default_rng(many)
    points = rng.normal(size=(many, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    graph = Hnsw.build(points, np.arange(many))
    queries = points[:200] + rng.normal(size=(min(many, 200), 16)) * 0.05
    found, near_by = graph.search(queries, 64)
    best = (queries @ points.T).argmax(axis=1)
    assert (found[:, 0] == best).mean() >= 0.95
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in found)


@pytest.mark.parametrize("columns", [3, 40, 1600, 5003])
def test_largest_by_blocks(columns):
    values = np.random.default_rng(columns).normal(size=(7, columns))
    many = min(48, columns - 1)
    found = np.take_along_axis(values, largest(values, many), 1)
    assert (np.sort(found, axis=1) == np.sort(values, axis=1)[:, -many:]).all()


@pytest.mark.parametrize("changed", [4, 6])
def test_a_template_is_joined_by_few_trials(spark, monkeypatch, changed):
    """Pages of one template, alike by more or by less than the bound: what is verified grows with their number."""
    pick = random.Random(changed)
    base = [f"w{i}" for i in range(400)]
    many, rows = (400 if changed == 4 else 120), []
    for i in range(many):
        words = list(base)
        for k in pick.sample(range(400), changed):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    tried, plain = [], near.verified
    monkeypatch.setattr(near, "verified", lambda pairs, *rest: (tried.append(pairs.count()), plain(pairs, *rest))[1])
    edges, union = [], near.components
    monkeypatch.setattr(near, "components", lambda df: (edges.append(df.count()), union(df))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(docs, least=0.75).collect()}
    sets = [set(near.set_of(t, 5).tolist()) for _, t in rows]
    alike = [(i, j) for i in range(many) for j in range(i) if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])]
    root = list(range(many))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in alike:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert got == {i: find(i) for i in range(many)}
    if changed == 4:
        assert len(alike) > 20 * many and sum(tried) <= 6 * many
    assert sum(edges) <= 3 * many
