import hashlib
import random

import numpy as np
import pytest
from deltaspan.llm import clusters
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, distance int, id string, v string, c int, s string"


def lloyd(rows, size, k, rounds):
    """By definition, in Python integers: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    own = [(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    c = [v for i, v in sorted((r for r in own if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]] or [(0,) * size]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in own]
        for j in range(len(c)):
            if members := [v for (_, v), x in zip(own, of) if x == j]:
                c[j] = tuple(sum(x) // len(members) for x in zip(*members))
    last = [near(v) for _, v in own]
    whole = sum(d for d, _ in last)
    return [(i, j, d, sum(e for e, x in last if x == j), whole, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(own, last)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(spark, rows, size=64, k=16, rounds=3):
    rows = [(*r, 1, "x", 2, "i", "v", 3, "s") for r in rows]
    got = clusters.clustered(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding", size, k, rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(lloyd(rows, size, k, rounds), key=key)
    return got


def test_odd_vectors(spark):
    """Nulls, wrong lengths, non-finite parts, repeated vectors and ids, no ids, ties, and large components."""
    rng = random.Random(1)
    gauss = lambda: [rng.gauss(0, 0.3) for _ in range(64)]
    rows = [(i, gauss()) for i in range(150)]
    rows += [(200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 65), (204, [*[0.0] * 63, None]), (205, [*[0.0] * 63, float("nan")]), (206, [*[0.0] * 63, float("inf")]), (207, [*[0.0] * 63, float("-inf")])]
    rows += [(i, [0.0] * 64) for i in range(300, 360)] + [(3, rows[3][1]), (3, gauss()), (None, gauss()), (None, [0.0] * 64), (400, [-0.0] * 64), (401, [1e4] * 64), (402, [-1e4] * 64)]
    check(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 5, 16, 17])
def test_few_vectors(spark, n):
    rng = random.Random(n)
    assert check(spark, [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(n)]).count() == n


def test_ties(spark):
    """Small whole components: many vectors are equally near to two centroids, some centroids are equal."""
    rng = random.Random(2)
    check(spark, [(i, [rng.randrange(-1, 2) / 64 for _ in range(4)]) for i in range(400)], 4, 9, 5)
    check(spark, [(i, [(i % 3) / 64, 0.0]) for i in range(60)], 2, 8, 4)


def test_one_centroid(spark):
    check(spark, [(i, [i / 7, -i / 5]) for i in range(30)], 2, 1, 3)


def test_bounds():
    """Bounds hold in each round, skip most vectors, and rounds end as full scans do, also beyond what doubles hold."""
    rng = np.random.default_rng(5)
    for spread, size in ((1, 8), (3, 8), (1 << 20, 8), (1 << 26, 64)):
        centre = rng.integers(-6 * spread, 6 * spread, (9, size)) if spread < 1 << 25 else rng.integers(-spread, spread, (9, size))
        v = np.clip(centre[rng.integers(0, 9, 3000)] + rng.integers(-spread, spread + 1, (3000, size)), -clusters.LARGEST, clusters.LARGEST)
        c = v[:9].copy()
        best, upper, lower = clusters.scanned(v, c)
        compared = []
        for _ in range(6):
            before, c = c, np.array([v[best == j].sum(axis=0) // max(1, (best == j).sum()) if (best == j).any() else c[j] for j in range(9)])
            best, upper, lower, n = clusters.stepped(v, best, upper, lower, c, before)
            compared.append(n)
            d = np.stack([[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v[:300]]).astype(object)
            assert [min(range(9), key=lambda j: (row[j], j)) for row in d] == best[:300].tolist()
            for i, row in enumerate(d):
                assert int(np.ceil(upper[i])) ** 2 >= row[best[i]] and int(np.floor(lower[i])) ** 2 <= min(x for j, x in enumerate(row) if j != best[i])
        assert compared[-1] < 1500


def test_held_components(spark):
    """A component beyond 2^20 is held there; sums of distances beyond 64 bits are null."""
    got = clusters.clustered(spark.createDataFrame([(i, [1e30 * (-1) ** i] * 64) for i in range(40)], "vec_id bigint, embedding array<double>"), "vec_id", "embedding", 64, 1, 1).collect()
    assert len(got) == 40 and all(r["distance"] == 64 * clusters.LARGEST**2 for r in got) and all(r["inertia"] is None for r in got)
    one = spark.createDataFrame([(1, [1.5, -0.01])], "i int, e array<double>").select(clusters.integers(F.col("e"), 2).alias("v")).first()["v"]
    assert one == [96, -1]
