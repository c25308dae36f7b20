import hashlib

import numpy as np
import pytest
from nodeloom.llm import ball_tree as bt

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10, size=64):
    """vec_id-wise clusters and distances, all in Python integers."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted(((i, *reversed(near(v))) for i, v in kept), key=str), centroids


def result(df):
    vectors = bt.kept(df)
    forest = bt.trees(vectors)
    centroids = bt.fit(forest, bt.first_centroids(vectors))
    return sorted(map(tuple, bt.assigned(forest, centroids).collect()), key=str), centroids


def clustered(seed, n, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(8, 64))
    return [(i, (middles[i % 8] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.5, 3.0])
def test_equals_brute_force(spark, spread):
    rows = clustered(1, 700, spread)
    got, centroids = result(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3))
    want, means = brute(rows)
    assert got == want and centroids.tolist() == means


def test_ties_and_small_leaves(spark, monkeypatch):
    monkeypatch.setattr(bt, "LEAF", 2)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(0, 2, 64) / 1024).tolist()) for i in range(150)] + [(500 + i, [0.0] * 64) for i in range(30)]
    got, centroids = result(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))
    want, means = brute(rows)
    assert got == want and centroids.tolist() == means


def test_whole_balls_are_assigned():
    rows = np.array([v for _, v in clustered(3, 4096, 0.05)])
    v = np.floor(rows * 1024).astype(np.int64)
    order, radii, sums, counts = bt.build(v)
    tree = bt.Tree({"ids": order.astype(np.int64).tobytes(), "known": np.ones(len(v), bool).tobytes(), "vectors": v[order].astype(np.int32).tobytes(), "radii": radii.tobytes(), "sums": sums.tobytes(), "counts": counts.tobytes()})
    count, total, compared = tree.totals(v[:8])
    own = bt.squared(v, v[:8]).argmin(axis=1)
    assert compared < len(v) / 4  # most vectors are settled with their ball
    assert count.tolist() == np.bincount(own, minlength=8).tolist()
    assert np.array_equal(total, np.stack([v[own == j].sum(axis=0) for j in range(8)]))


def test_large_components_are_exact():
    rng = np.random.default_rng(4)
    v = rng.integers(-(1 << 27), 1 << 27, (20, 64))
    assert bt.squared(v, v[:3]).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)) for b in v[:3]] for a in v]


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(*r, 0) for r in clustered(5, 300, 1.0)], SCHEMA)
    assert result(df.coalesce(1))[0] == result(df.repartition(9))[0]


def test_edges(spark):
    good = clustered(6, 20, 1.0)
    bad = [(100, None), (101, [1.0] * 63), (102, [1.0] * 63 + [None]), (103, [1.0] * 63 + [float("nan")]), (104, [float("inf")] + [1.0] * 63), (105, []), (106, [1.0] * 65)]
    odd = [(None, [0.5] * 64), (None, [0.5] * 64), (3, [-0.25] * 64), (3, [-0.25] * 64)]
    rows = good + bad + odd
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).selectExpr("*", "1 AS cluster", "'x' AS distance", "2 AS v")
    got, centroids = result(df)
    want, means = brute(rows)
    assert got == want and centroids.tolist() == means and len(got) == 24
    few = good[:3]
    assert result(spark.createDataFrame([(*r, 0) for r in few], SCHEMA))[0] == brute(few)[0]
    assert result(df.limit(0))[0] == []
    with pytest.raises(Exception, match="too large"):
        result(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA))
