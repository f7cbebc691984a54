import numpy as np
import pytest

from papergrid.llm import graph, knn


def brute(ids, vectors, k):
    unit = vectors.astype(float) / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    out = {}
    for i, own in enumerate(ids):
        order = [j for j in np.lexsort((ids, -np.round(sims[i], 12))) if j != i][:k]
        out[own] = [ids[j] for j in order]
    return out


def test_graph_recall():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, entries = graph.build(x)
    assert near.shape == (1500, graph.DEGREE) and (near < 1500).all()
    assert all(i not in near[i] for i in range(1500))
    found, sims = graph.search(x, near, entries, x[:300], 40)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([np.isin(t, f).mean() for t, f in zip(true, found)]) > 0.95
    assert (np.diff(sims, axis=1) <= 1e-6).all()
    for n in (0, 1, 2):
        g, e = graph.build(x[:n])
        assert len(graph.search(x[:n], g, e, x[:3], 5)[0]) == 3


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).round(3)
    ids = np.arange(1000, 1400)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    rows += rows[:30]  # repeated rows
    rows += [(9000 + i, x[0].tolist()) for i in range(40)]  # many copies of one vector
    bad = [(1, None), (2, []), (3, [0.0] * 8), (4, [float("nan")] + [1.0] * 7), (5, [1.0] * 9), (6, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (7, [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>")
    got = {}
    for r in knn.nearest(knn.usable(df, "vec_id", "embedding", 8), 10).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    all_ids = np.concatenate([ids, 9000 + np.arange(40)])
    want = brute(all_ids, np.concatenate([x, np.repeat(x[:1], 40, 0)]).astype(np.float32), 10)
    assert set(got) == set(want) and all(sorted(p for p, _ in v) == list(range(1, 11)) for v in got.values())
    assert np.mean([len({o for _, o in got[i]} & set(want[i])) / 10 for i in want]) > 0.95
    assert [o for _, o in sorted(got[9039])] == want[9039]  # ties by id
    pairs = knn.neighbour_pairs(knn.usable(df, "vec_id", "embedding", 8), 10)
    assert pairs.where("vec_a >= vec_b").count() == 0 and pairs.count() == pairs.distinct().count()


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id bigint, embedding array<float>")
    assert knn.neighbour_pairs(knn.usable(df, "vec_id", "embedding", 2)).count() == max(0, n - 1)


def test_nested(spark):
    df = spark.createDataFrame([([1, 2, 3], [[1.0, 0.0], None]), (None, [[1.0, 1.0]]), ([None, 5], [[1.0, 0.0], [2.0, 2.0]])], "ids array<bigint>, vs array<array<float>>")
    assert sorted(r.id for r in knn.usable_nested(df, "ids", "vs", 2).collect()) == [1, 5]


def test_divided_shards(spark, monkeypatch):
    """Shards that are too large are divided by pivots of their own, again and again."""
    for name, value in (("SHARD_ROWS", 20), ("PIVOTS_MOST", 4), ("SHARD_MOST", 40), ("CHUNK", 50)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    vectors = knn.usable(df, "vec_id", "embedding", 6)
    sizes = knn.shards(knn._classes(vectors)[1], 600, 0.5, (3, 4)).where("home").groupBy("shard").count().collect()
    assert sum(r["count"] for r in sizes) == 600 and max(r["count"] for r in sizes) <= 80 and len(sizes) > 4
    got = {}
    for r in knn.nearest(vectors, 5, margin=0.5, probes=(3, 4)).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(np.arange(600), x, 5)
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in want]) > 0.9


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "BLOCK", 50)
    x = np.random.default_rng(3).normal(size=(300, 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(15)]
    vectors = knn.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "vec_id", "embedding", 6)
    got = {}
    for r in knn.exact(vectors, knn.F.col("id") % 10 == 0, 5).collect():
        got.setdefault(r.id, {})[r.place] = r.other
    want = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32), 5)
    assert {i: [got[i][p] for p in range(1, 6)] for i in got} == {i: want[i] for i in want if i % 10 == 0}
