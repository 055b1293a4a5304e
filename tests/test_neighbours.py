"""Nearest neighbours against all pairs."""

import math

import numpy as np
import pytest

from quern.operators import neighbours

SCHEMA = "key long, vec array<double>"


def vectors(kind, n, seed):
    r = np.random.default_rng(seed)
    if kind == "clusters":
        return (np.random.default_rng(0).normal(size=(12, 16)) * 6)[r.integers(0, 12, n)] + r.normal(size=(n, 16)) * 0.3
    if kind == "hot":  # most vectors in one narrow cone, many equal
        x = np.ones((n, 8)) + r.normal(size=(n, 8)) * 0.01
        x[: n // 3] = x[0]
        return x
    return r.normal(size=(n, 12))


def frame(spark, x, first=0):
    rows = [(first + i, [float(e) for e in v]) for i, v in enumerate(x)]
    return neighbours.unit_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), "key", "vec")


@pytest.mark.parametrize("kind", ["clusters", "hot", "random"])
def test_equal_to_all_pairs(spark, kind):
    stored, asked, k = vectors(kind, 1500, 1), vectors(kind, 120, 2), 4
    index = neighbours.Index(frame(spark, stored), pivots=20, block=64)
    got = {}
    for r in index.nearest(frame(spark, asked, 10_000), k).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.near, r.cosine)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit(asked) @ unit(stored).T
    assert len(got) == 120
    for q, row in enumerate(cosine):
        mine = [got[10_000 + q][i] for i in range(1, k + 1)]
        best = sorted(((-round(c, 9), i) for i, c in enumerate(row)))[:k]
        assert [round(c, 9) for _, c in mine] == [-c for c, _ in best]
        if kind != "random":
            assert all(math.isclose(row[i], c, abs_tol=1e-9) for i, c in mine)
    sizes = [r["count"] for r in index.rows.groupBy("cell", "ring", "part").count().collect()]
    assert max(sizes) <= 2 * 64 and len(sizes) >= 1500 // 128


def test_clusters_spare_most_blocks(spark, monkeypatch):
    index = neighbours.Index(frame(spark, vectors("clusters", 3000, 1)), pivots=60, block=64)
    seen = []
    compared = index._compared
    monkeypatch.setattr(index, "_compared", lambda visits, k: seen.append(visits.count()) or compared(visits, k))
    index.nearest(frame(spark, vectors("clusters", 100, 2), 10_000), 3).collect()
    assert seen[0] == 100 and seen[1] < 0.35 * 100 * index.blocks.count()


def test_odd_vectors(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [-1.0, -2.0]), (9, []), (None, [1.0, 2.0])]
    units = neighbours.unit_vectors(spark.createDataFrame(rows, SCHEMA), "key", "vec")
    assert sorted(r.id for r in units.collect()) == [1, 2, 8]
    got = sorted(tuple(r) for r in neighbours.Index(units).nearest(units, 5).collect())
    assert [(a, b, round(c, 9)) for a, b, c, _ in got] == [(1, 1, 1.0), (1, 2, 1.0), (1, 8, -1.0), (2, 1, 1.0), (2, 2, 1.0), (2, 8, -1.0), (8, 1, -1.0), (8, 2, -1.0), (8, 8, 1.0)]


def test_nothing_stored(spark):
    none = neighbours.unit_vectors(spark.createDataFrame([], SCHEMA), "key", "vec")
    assert neighbours.Index(none).nearest(none, 3).collect() == []
    assert neighbours.Index(none).nearest(frame(spark, vectors("random", 3, 1)), 3).collect() == []
