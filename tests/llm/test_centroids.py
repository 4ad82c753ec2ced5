import hashlib
import math

import numpy as np
import pytest

from reelscope.llm import centroids as op

SCHEMA = "vec_id long, embedding array<double>, cluster string, inertia int"


def plain(rows, k, rounds, dimension, scale=64):
    """Rounds over Python's integers, every centroid compared."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    whole = lambda v: [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in v]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    points, centres = [(i, whole(v)) for i, v in kept], [whole(v) for _, v in first]
    near = lambda p: min((sum((x - y) ** 2 for x, y in zip(p, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        found = [near(p)[1] for _, p in points]
        for n in range(len(centres)):
            own = [p for (_, p), c in zip(points, found, strict=True) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(p)[::-1]) for i, p in points]
    sums = {n: sum(min(d, op.LARGEST) for _, c, d in last if c == n) for n in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    big = lambda x: min(x, op.LARGEST)
    return sorted(((i, c, big(d), big(sums[c]), big(sum(sums.values())), sha[c]) for i, c, d in last), key=str)


def rows_of(found):
    return sorted(map(tuple, found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize(("n", "k", "dimension", "spread"), [(300, 16, 4, 1.0), (200, 5, 3, 30.0), (9, 16, 4, 1.0), (400, 12, 2, 0.05)])
def test_against_all_centroids(spark, n, k, dimension, spread):
    rng = np.random.default_rng(n)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(n, dimension)) * spread)] + [(1, [0.0] * dimension)] * 3
    frame = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA).repartition(3)
    assert rows_of(op.clustered(frame, k, 3, dimension)) == plain(rows, k, 3, dimension)


def test_awkward_rows(spark):
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("-inf"), 1.0])]
    good = [(None, [0.5, 0.5]), (None, [0.25, 0.5]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (8, [-0.001, 0.0]), (9, [0.0, -0.0])]
    frame = spark.createDataFrame([(i, v, None, None) for i, v in odd + good], SCHEMA)
    assert rows_of(op.clustered(frame, 4, 3, 2)) == plain(odd + good, 4, 3, 2)
    assert rows_of(op.clustered(frame, 1, 0, 2)) == plain(odd + good, 1, 0, 2)
    none = op.clustered(frame.filter("vec_id < 7"), 4, 3, 2)
    assert none.count() == 0 and none.columns == op.clustered(frame, 4, 3, 2).columns


def test_beyond_exact_floats(spark):
    """Components of any size are summed and compared as integers; a distance or sum beyond a long is the largest long."""
    rows = [(k, [float(3**k), -float(7 ** (k // 2))]) for k in range(12)] + [(20, [1e300, 1e300]), (21, [1e300, -1e12]), (22, [5e15, 5e15]), (23, [1.7e308, 0.0])]
    frame = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    assert rows_of(op.clustered(frame, 5, 3, 2)) == plain(rows, 5, 3, 2)


def test_annulus_leaves_out_and_ties():
    own = op.Annulus([[0, 0], [3, 0], [0, 3], [100, 0], [3, 0]])
    seen = []
    full = own.distances
    own.distances = lambda v, k: seen.append((int(k), len(v))) or full(v, k)
    best, least = own.nearest(np.array([[3.0, 0.0], [0.0, 3.0], [2.0, 2.0], [0.0, 0.0]]))
    assert (best.tolist(), least.tolist()) == ([1, 2, 1, 0], [0, 0, 5, 0])
    assert sum(n for k, n in seen if k == 3) == 0
    point = np.array([[1.5, 0.0]])  # as far from 0 as from 1
    assert own.nearest(point)[0].tolist() == [0]


def test_limbs():
    for x in (0, 5, -5, 2**30, -(2**61) - 7, 3**200):
        parts = op.limbs(x)
        assert sum(v << 30 * k for k, v in enumerate(parts)) == x and all(abs(v) < 2**30 for v in parts)
