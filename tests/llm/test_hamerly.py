"""Clustering with bounds gives the rows of plain rounds."""

import hashlib
import math

import numpy as np

from larkspar.llm import hamerly
from larkspar.llm.common import Scratch
from tests.compare import oracle, rows

COLUMNS = "vec_id long, embedding array<float>, label int, cluster string, v int, distance int, upper int, totals int, n string, h string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "a", 2, 3, 4, 5, "b", "c") for i, v in vectors], COLUMNS)


def plain(vectors, k=8, rounds=10):
    """(vec_id, cluster, distance, centroid hash) by loops over Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), n in zip(kept, of) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, hashes[n]) for i, v in kept for d, n in [nearest(v)]]


def odd_vectors():
    r = np.random.default_rng(5)
    clouds = r.normal(size=(12, 64))
    out = [(i, (clouds[i % 12] + 0.3 * r.normal(size=64)).astype(np.float32).tolist()) for i in range(150)]
    same = out[7][1]
    out += [(200 + i, same) for i in range(30)]  # copies
    out += [(3, out[3][1]), (3, out[4][1]), (None, out[9][1]), (None, out[9][1])]  # repeated and null ids
    out += [(300, None), (301, []), (302, same[:-1]), (303, same + [0.0]), (304, [None] + same[1:]), (305, [float("nan")] + same[1:]), (306, [float("inf")] + same[1:]), (307, [-float("inf")] * 64)]
    return out + [(400, [0.0] * 64), (401, [-0.0] * 64), (402, [1 / 1024] * 64), (403, [-1 / 2048] * 64)]


def found(spark, vectors, **how):
    out = hamerly.described(hamerly.cluster(frame(spark, vectors), Scratch(spark, "hamerly"), **how)).collect()
    assert all(r["cluster_inertia"] == sum(x["distance"] for x in out if x["cluster"] == r["cluster"]) for r in out)
    assert {r["inertia"] for r in out} == {sum(r["distance"] for r in out)}
    return sorted([(r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in out], key=repr)


def test_bounds_give_the_rows_of_plain_rounds(spark):
    vectors = odd_vectors()
    assert found(spark, vectors) == sorted(plain(vectors), key=repr)


def test_ties_and_few_vectors(spark):
    flat = [(i, [float(i % 2)] * 64) for i in range(20)]  # two points, eight centroids: six are copies and stay empty
    assert found(spark, flat) == sorted(plain(flat), key=repr)
    few = odd_vectors()[:3]
    assert found(spark, few) == sorted(plain(few), key=repr)
    one = odd_vectors()[:1]
    assert found(spark, one, rounds=2) == sorted(plain(one, rounds=2), key=repr)
    assert hamerly.cluster(frame(spark, []), Scratch(spark, "hamerly")) is None
    assert hamerly.cluster(frame(spark, [(1, None)]), Scratch(spark, "hamerly")) is None


def test_bounds_spare_most_scans_of_separate_clouds(spark):
    r = np.random.default_rng(6)
    clouds = 4 * r.normal(size=(8, 64))
    vectors = [(i, (clouds[i % 8] + 0.1 * r.normal(size=64)).astype(np.float32).tolist()) for i in range(400)]
    scanned = hamerly.cluster(frame(spark, vectors), Scratch(spark, "hamerly")).scanned
    assert scanned[0] == 400 and sum(scanned[3:]) < 0.1 * 400 * len(scanned[3:])


def test_bounds_hold_for_every_vector():
    """After any drift the upper bound is not below the true distance and the lower one not above the second."""
    r = np.random.default_rng(8)
    v, c = r.integers(-2000, 2000, (500, 64)), r.integers(-2000, 2000, (6, 64))
    cluster, upper, lower, before = np.full(500, -1), np.full(500, np.inf), np.zeros(500), None
    for _ in range(6):
        cluster, upper, lower, _ = hamerly.Bounds(c, before).assign(v, cluster, upper, lower)
        d = np.sqrt(hamerly.squared(v, c).astype(float))
        own = d[np.arange(500), cluster]
        d[np.arange(500), cluster] = np.inf
        assert (hamerly.squared(v, c).argmin(1) == cluster).all() and (own <= upper).all() and (lower <= d.min(1)).all()
        before, c = c, c + r.integers(-60, 60, c.shape)


def test_components_too_large_raise(spark):
    import pytest

    with pytest.raises(Exception, match="beyond"):
        hamerly.cluster(frame(spark, [(1, [1e9] * 64)]), Scratch(spark, "hamerly"))


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows(hamerly.op13(spark, sf).toPandas()) == rows(oracle(hamerly.OP13_SQL, sf))
