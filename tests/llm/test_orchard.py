"""Orchard's search against distances to every centroid."""

import hashlib

import numpy as np
import pytest

from tidemill.llm import orchard

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, _v string"


def brute(points, centroids):
    d = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("spread", [1, 3, 400])
def test_nearest_with_ties_from_any_start(spread):
    rng = np.random.default_rng(spread)
    # Few different values, so that many distances are equal; repeated centroids too.
    points = rng.integers(-spread, spread + 1, (500, 6))
    centroids = np.concatenate([points[:15], points[:5]])
    want = brute(points, centroids)
    for start in (None, rng.integers(0, 20, 500), np.full(500, 19)):
        best, dist, _ = orchard.nearest(points, centroids, start)
        assert (best == want[0]).all() and (dist == want[1]).all()


def test_search_looks_at_few_centroids_where_vectors_are_grouped():
    rng = np.random.default_rng(1)
    middles = rng.integers(-1000, 1000, (40, 64))
    of = rng.integers(0, 40, 2000)
    points = middles[of] + rng.integers(-20, 20, (2000, 64))
    best, _, computed = orchard.nearest(points, middles, of)
    assert (best == of).all() and computed < 2 * len(points)


def test_one_centroid():
    best, dist, _ = orchard.nearest(np.array([[3], [5]]), np.array([[4]]))
    assert best.tolist() == [0, 0] and dist.tolist() == [1, 1]


def plain(vectors, k, rounds):
    """Integers, first centroids and rounds in plain numpy: (id, cluster, distance) and centroids."""
    kept = [(i, np.floor(256 * np.float32(v).astype(np.float64)).astype(np.int64)) for i, v in vectors]
    hashed = [(hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~", v.tolist()) for i, v in kept]
    centroids = np.array([v for _, v in sorted(hashed)[:k]])
    points = np.array([v for _, v in kept])
    for _ in range(rounds):
        best, _ = brute(points, centroids)
        for c in set(best.tolist()):
            mine = points[best == c]
            centroids[c] = mine.sum(axis=0) // len(mine)
    best, dist = brute(points, centroids)
    return sorted(zip([i for i, _ in kept], best.tolist(), dist.tolist()), key=repr), centroids


def test_rounds_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(0, 0.3, 4).round(1).tolist()) for i in range(120)]
    good += [(7, [0.1, 0.1, 0.1, 0.1]), (None, [0.5, -0.5, 0.0, 0.0]), (None, [0.5, -0.5, 0.0, 0.0])] + good[:30]
    bad = [
        (200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 5), (204, [1.0, None, 1.0, 1.0]),
        (205, [float("nan"), 0.0, 0.0, 0.0]), (206, [float("inf"), 0.0, 0.0, 0.0]), (207, [-float("inf"), 0.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in good + bad], SCHEMA).repartition(3)
    assigned, centroids = orchard.cluster(df, k=9, rounds=3, size=4)
    got = orchard.describe(assigned, centroids).collect()
    want, middle = plain(good, 9, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == want
    assert (centroids == middle).all()
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_few_none_and_huge_vectors(spark):
    one = spark.createDataFrame([(1, [2.0**100, -(2.0**100), 0.0, 1.0], 1, "", "")], SCHEMA)
    row = orchard.describe(*orchard.cluster(one, size=4)).first()
    assert (row.cluster, row.distance, row.inertia) == (0, 0, 0)
    assert orchard.cluster(one, size=4)[1].tolist() == [[2**27, -(2**27), 0, 256]]
    none = orchard.describe(*orchard.cluster(one.limit(0), size=4))
    assert none.count() == 0
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
