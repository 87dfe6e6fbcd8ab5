"""Vector operators against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cardloom.llm import near_vectors, posting_lists
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist(), 0) for k in range(300)]
    rows += [(300 + k, (np.array(rows[5][1]) + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), 0) for k in range(20)]
    rows += [(400 + k, rows[9][1], 0) for k in range(25)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] + [1.0] * 15, 0), (503, [None] + [1.0] * 15, 0), (504, [float("inf")] * 16, 0), (505, [], 0)]
    rows += [(None, rows[1][1], 0), (506, [1.0, 2.0], 0), (7, rows[7][1], 0), (508, (2 * np.array(rows[3][1])).tolist(), 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def good(row, dim=16):
    v = row.embedding
    return row.vec_id is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_vectors(vectors):
    rows = vectors.collect()
    use = [r for r in rows if good(r)]
    x = np.array([r.embedding for r in use], float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    label = np.array([r.vec_id for r in use])
    while True:
        new = np.array([label[line].min() for line in link])
        if (new == label).all():
            break
        label = new
    expected = [(r.vec_id, int(line.sum()) - 1, int(c), bool(r.vec_id == c)) for r, line, c in zip(use, link, label)]
    expected += [(r.vec_id, 0, r.vec_id, True) for r in rows if not good(r)]
    renamed = vectors.withColumn("node", F.lit(1)).withColumn("cell", F.lit(1)).withColumn("n_links", F.lit(1))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(renamed).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_near_vectors_in_many_tiles(vectors, monkeypatch):
    whole = sorted(map(str, near_vectors.near_duplicates(vectors).collect()))
    monkeypatch.setattr(near_vectors, "TILE", 20)
    assert sorted(map(str, near_vectors.near_duplicates(vectors).collect())) == whole


def test_near_vectors_in_many_rounds(vectors, monkeypatch):
    """Tiles are sent in rounds of bounded size, and none is exchanged for the pairs it is in."""
    whole = sorted(map(str, near_vectors.near_duplicates(vectors).collect()))
    plans, plain = [], near_vectors.written

    def noting(df, name, **more):
        plans.extend([df._jdf.queryExecution().optimizedPlan().toString()] if name == "near-links" else [])
        return plain(df, name, **more)

    monkeypatch.setattr(near_vectors, "written", noting)
    monkeypatch.setattr(near_vectors, "TILE", 20)
    monkeypatch.setattr(near_vectors, "ROUND_BYTES", 8000)
    assert sorted(map(str, near_vectors.near_duplicates(vectors).collect())) == whole
    assert len(plans) > 2 and all("MapInArrow" in x and "FlatMapGroups" not in x for x in plans)


def test_vectors_of_extreme_scale(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(k, (base * scale).tolist()) for k, scale in enumerate((1.0, 1e200, 1e-200, 1e-300, -1e250))]
    rows += [(10 + k, rng.normal(size=8).tolist()) for k in range(20)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[k] for k in range(5)] == [(3, 0)] * 4 + [(0, 4)]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.0, 0.3))
def test_bounds_lose_no_link(seed, spread):
    rng = np.random.default_rng(seed)
    left = rng.normal(size=(30, 8))
    right = np.concatenate([left + rng.normal(size=left.shape) * spread, rng.normal(size=(5, 8))])
    cos = (left @ right.T) / np.linalg.norm(left, axis=1)[:, None] / np.linalg.norm(right, axis=1)
    pairs = {(a, b) for i, j in near_vectors.linked_pairs(left, right, 0.95) for a, b in zip(i.tolist(), j.tolist())}
    sure, maybe = np.argwhere(cos >= 0.95 + 1e-12), np.argwhere(cos >= 0.95 - 1e-12)
    assert set(map(tuple, sure.tolist())) <= pairs <= set(map(tuple, maybe.tolist()))


def test_empty_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_vectors.near_duplicates(none).count() == 0
    assert posting_lists.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_nearest(vectors):
    use = [r for r in vectors.collect() if good(r)]
    by_id = {r.vec_id: np.array(r.embedding, float) for r in use}
    renamed = vectors.withColumn("list", F.lit(1)).withColumn("score", F.lit(1)).withColumn("v", F.lit(1))
    got = {}
    for r in posting_lists.nearest(renamed, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in by_id if i % 20 == 0}
    for query, found in got.items():
        scores = {i: float((by_id[query] * v).sum()) for i, v in by_id.items() if i != query}
        best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert [i for _, i, _ in sorted(found)] == best  # one list: the search is exact
        assert all(abs(s - scores[i]) < 1e-12 for _, i, s in found)


def test_recall_over_many_lists(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(6000, 32))
    points /= np.linalg.norm(points, axis=1)[:, None]
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {}
    for r in posting_lists.nearest(df, F.col("vec_id") % 100 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for query, found in got.items():
        near = points @ points[query]
        near[query] = -9
        hits += len(found & set(np.argsort(-near)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_ratio_follows_recall():
    """With many lists the ratio is widened until the measured queries find enough."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(40_000, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    centres = posting_lists.balanced_centroids(posting_lists._lifted(points[:8000], 1.0), 400, rounds=3)
    index = posting_lists.Index(centres, posting_lists.centroid_graph(centres), 1.0, 1.0)
    queries = points[:100]
    near = np.argsort(-(queries @ points.T), axis=1)[:, 1:21]
    owner = np.repeat(np.arange(len(queries)), 20)
    index = index._replace(ratio=posting_lists.least_ratio(index, queries, owner, points[near.reshape(-1)]))
    row, held = posting_lists.own_lists(index, posting_lists._lifted(points[near.reshape(-1)], 1.0))
    hits = np.zeros(len(owner), bool)
    for r, x in zip(row, held):
        hits[r] |= x in posting_lists.search_lists(index, np.append(queries[owner[r]], 0.0)) if not hits[r] else False
    assert hits.mean() >= 0.95


def test_lonely_query_finds_k(spark):
    """Queries whose own lists hold fewer than k vectors search on."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(6000, 16)) * 0.01 + np.eye(16)[0]
    points[::600] = -np.eye(16)[rng.integers(1, 16, 10)] * 50 + rng.normal(size=(10, 16))
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {}
    for r in posting_lists.nearest(df, F.col("vec_id") % 300 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {len(x) for x in got.values()} == {20} and len(got) == 20
